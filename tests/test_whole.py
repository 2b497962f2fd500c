"""Registered queries over whole sequences, against brute force on small tables of known content."""

from __future__ import annotations

import random

import pytest

from readloom.functions.sequence import BASES
from readloom.operators.alignment import align_all, flip
from readloom.plans import file_queries as FQ
from readloom.plans import read_queries as Q

WAYS = {"FWD": lambda s: s, "RVS": lambda s: s[::-1], "RVS_CMP": lambda s: flip(s)[::-1], "CMP": flip}


def _seq(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice("ACGT") for _ in range(n))


def _changed(rnd: random.Random, s: str, n: int) -> str:
    for i in rnd.sample(range(len(s)), n):
        s = s[:i] + rnd.choice([b for b in "ACGT" if not BASES[b] & BASES[s[i]]] or "A") + s[i + 1 :]
    return s


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Six probes, one with a code in its primer; reads of a barcode, a primer in any orientation with 0 to 3 mismatches, and a tail."""
    rnd, path = random.Random(5), tmp_path_factory.mktemp("whole")
    probes = [(f"P{i}", "+" if i % 2 else "-", _seq(rnd, 22 + i), _seq(rnd, 20 + i), _seq(rnd, 60)) for i in range(6)]
    probes[0] = (*probes[0][:2], probes[0][2][:9] + "R" + probes[0][2][10:], *probes[0][3:])
    probes[1] = (*probes[1][:4], probes[1][4][:30] + probes[1][2][:20] + flip(probes[1][2][20]) + probes[1][2][21:] + probes[1][4][30:])
    pairs = []
    for i in range(120):
        p = probes[i % 6]
        way = list(WAYS.values())[i // 6 % 4] if i < 96 else WAYS["FWD"]
        primer = way(p[2] if i % 5 or i >= 96 else p[3])
        uid = _seq(rnd, 14 - (i % 3))
        seq = uid + _changed(rnd, primer, i % 4).replace("R", "A").replace("Y", "C") + _seq(rnd, i % 7)
        pairs.append((i, p[0], uid, seq, "I" * len(seq), _seq(rnd, 20 + i % 17), "I" * (20 + i % 17)))
    spark.createDataFrame(probes, "probe_id string, strand string, ext_sequence string, lig_sequence string, target_sequence string").write.parquet(f"{path}/probes.parquet")
    spark.createDataFrame(pairs, "read_index long, probe_id string, ext_uid string, r1_seq string, r1_qual string, r2_seq string, r2_qual string").write.parquet(f"{path}/pairs.parquet")
    return str(path), probes, pairs


def test_find_and_trim_whole_primers(spark, tables):
    path, probes, pairs = tables
    want = set()
    sought = [(p[0], kind, way, f(s)) for p in probes for kind, s in (("extension", p[2]), ("ligation", p[3])) for way, f in WAYS.items()]
    keys = [(i, r1, *x) for i, _, _, r1, *_ in pairs for x in sought]
    for (i, _, ident, kind, way, _), (ref, qry, _) in zip(keys, align_all([(k[1], k[5]) for k in keys]), strict=True):
        a, z = len(qry) - len(qry.lstrip("-")), len(qry.rstrip("-"))
        ref_in, qry_in = ref[a:z], qry[a:z]
        if "-" not in ref_in + qry_in and sum(not BASES[x] & BASES[y] for x, y in zip(ref_in, qry_in, strict=True)) <= 2:
            want.add((i, ident, kind, way, ref_in))
    got = Q.find_and_trim(spark, path)
    assert {tuple(r) for r in got.where("primary_id is not null").select("read_index", "primary_id", "secondary_id", "orientation", "found").collect()} == want
    assert {w[2] for w in want} == {"extension", "ligation"} and {w[3] for w in want} == set(WAYS) and ("P0", "extension") in {w[1:3] for w in want}
    assert len(want) > 60 and got.select("read_index").distinct().count() == 120
    s = Q.find_summary(spark, path).first()
    assert (s.reads, s.single + s.multiple) == (120, len({w[0] for w in want}))


def test_variable_uids_whole_primer(spark, tables):
    path, probes, pairs = tables
    ext = {p[0]: p[2] for p in probes}
    got = {(r.read, r.primer): r.uid for r in Q.variable_uids(spark, path).collect()}
    assert set(got) == {(r1, ext[probe]) for _, probe, _, r1, *_ in pairs}
    # Reads 96 and later hold the whole primer forward, after a barcode of 12 to 14 bases.
    known = [(r1, ext[probe], uid) for i, probe, uid, r1, *_ in pairs if i >= 96 and i % 4 == 0]
    assert len(known) == 6 and {len(u) for *_, u in known} == {12, 13, 14}
    assert [got[r, p] for r, p, _ in known] == [u for *_, u in known]


def test_comparisons_whole(spark, tables):
    path, probes, pairs = tables
    strings = {r.read_index: r for r in FQ.alignment_strings(spark, path).collect()}
    compared = {r.read_index: r for r in FQ.sequence_comparison(spark, path).collect()}
    assert len(strings) == len(compared) == len(pairs)
    for i, _, _, r1, _, r2, _ in pairs:
        n = min(len(r1), len(r2))
        a, b = r1[:n], r2[:n]
        assert tuple(compared[i]) == (i, sum(x != y for x, y in zip(a, b, strict=True)), "GAT" in a, a[2:6], 2 * n)
        a, b = a.replace("T", "-"), b.replace("G", "-")
        ops = "".join("=" if x == y else "I" if x == "-" else "D" if y == "-" else "X" for x, y in zip(a, b, strict=True))
        edits, wrong = ops.count("I") + ops.count("X"), sum(x != y for x, y in zip(a, b, strict=True))
        assert tuple(strings[i]) == (i, ops, edits, wrong, ops.count("="), n - ops.count("I"), ops.count("D"))
    assert max(len(r.ops) for r in strings.values()) > 30
    fits = lambda t, q: [k + 1 for k in range(len(t) - len(q) + 1) if sum(not BASES[x] & BASES[y] for x, y in zip(t[k:], q)) <= 1]  # noqa: B905, E731
    got = {r.probe_id: r.positions for r in Q.approximate_matches(spark, path).collect()}
    assert got == {p[0]: fits(p[4], p[2]) for p in probes} and got["P1"] == [31]
