import io
import random

import pytest
from bamfile import write_bam

from strandloom.sources import bam, formats

COLUMNS = ["qname", "flag", "qlen", "q_start", "q_end", "chrom", "strand", "t_start", "t_end", "exons", "aligned_bases", "cigar", "seq"]


def lines(count, seed=1):
    rng = random.Random(seed)
    out = ["@HD\tVN:1.6", *[f"@SQ\tSN:chr{i}\tLN:{100_000 + i}" for i in range(30)]]
    for i in range(count):
        if rng.random() < 0.1:
            n = rng.randrange(0, 40)
            out.append(f"read{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{''.join(rng.choices('ACGTN', k=n)) or '*'}\t*")
            continue
        ops = [(rng.randrange(1, 60), o) for o in rng.choice([["M"], ["S", "M"], ["M", "N", "M"], ["H", "M", "I", "M", "D", "M", "S"]])]
        n = sum(k for k, o in ops if o in "MIS=X")
        seq = "*" if rng.random() < 0.1 else "".join(rng.choices("ACGT", k=n))
        out.append(f"read{i}\t{rng.choice([0, 16, 256, 2064])}\tchr{rng.randrange(30)}\t{rng.randrange(1, 90_000)}\t60\t{''.join(f'{k}{o}' for k, o in ops)}\t*\t0\t0\t{seq}\t*")
    return out


@pytest.mark.parametrize("block, split", [(65_000, bam.SPLIT_BYTES), (900, 3_000), (200, 700), (64, 97)])
def test_ranges_have_every_record_once(block, split, tmp_path):
    rows = lines(400)
    path = write_bam(tmp_path / "a.bam", rows, block)
    reader = bam._Reader(path, split)
    got = [tuple(r.values())[1:] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [(f[0], int(f[1]), f[2], int(f[3]) - 1, f[5], f[9]) for f in (x.split("\t") for x in rows if x[0] != "@")]
    assert got == want
    places = [r["aln_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert places == sorted(set(places))


def test_spark_reads_bam_as_it_reads_sam(spark, tmp_path):
    rows = lines(300, 2)
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    path = write_bam(tmp_path / "a.bam", rows, 700)
    sam = formats.read_sam(spark, str(tmp_path / "a.sam")).orderBy("aln_id").select(*COLUMNS).collect()
    assert formats.read_bam(spark, path, split=2_000).orderBy("aln_id").select(*COLUMNS).collect() == sam
    assert formats.read_bam(spark, path).rdd.getNumPartitions() == 1
    head = sorted(map(tuple, formats.read_sam_header(spark, str(tmp_path / "a.sam")).collect()))
    assert sorted(map(tuple, formats.read_sam_header(spark, path).collect())) == head and len(head) == 30


def test_empty_and_broken_files(tmp_path):
    empty = bam._Reader(write_bam(tmp_path / "e.bam", lines(0)), 100)
    assert [b for p in empty.partitions() for b in empty.read(p)] == []
    whole = open(write_bam(tmp_path / "a.bam", lines(50), 100), "rb").read()
    with pytest.raises(ValueError):
        list(bam.read_records(io.BytesIO(whole[: len(whole) // 2]), 0, len(whole)))
    with pytest.raises(ValueError):
        bam.read_header(io.BytesIO(b"plain text, no blocks"))


def test_a_cigar_of_more_operations_than_a_record_can_count(tmp_path):
    n = 70_000
    cigar = "1M1I" * (n // 2)
    path = write_bam(tmp_path / "a.bam", ["@SQ\tSN:c\tLN:99999999", f"long\t0\tc\t5\t60\t{cigar}\t*\t0\t0\t{'AC' * (n // 2)}\t*"])
    with open(path, "rb") as f:
        (row,) = bam.read_records(f, 0, 1 << 30)
    assert row[5] == cigar and row[6] == "AC" * (n // 2)
