import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """Nodes of the next level, and per node (before, after) in its run."""
    runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
    return [digest(*r) for r in runs], [(r[:i], r[i + 1 :]) for r in runs for i in range(len(r))]


def tree(nodes):
    """Root, and per leaf its steps (before, after)."""
    steps, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        nodes, sides = up(nodes)
        for leaf, at in enumerate(owner):
            steps[leaf].append(sides[at])
            owner[leaf] = at // 8
    return nodes[0], steps


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: digest(*map(field, (r[0], r[3], r[2], r[4], text)))
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    ordered = sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    groups = [(k, list(g)) for k, g in groupby(ordered, key=key)]
    trees = [tree([leaf(r, r[1]) for r in g]) for _, g in groups]
    root, top_steps = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for (_, g), (subroot, steps), above in zip(groups, trees, top_steps, strict=True):
        for r, own in zip(g, steps, strict=True):
            path = own + above
            tamper = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lower(r[1]) if tamper else r[1])
            for before, after in path:
                folded = digest(*before, folded, *after)
            out.append((r[0], leaf(r, r[1]), subroot, root, digest(*(x for b, a in path for x in b + a)), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    text = lambda i: None if i % 11 == 0 else "" if i % 7 == 0 else f"Text {i % 5} ÄÖ " * (i % 4)
    return [(i // 2 if i % 13 == 0 else i, text(i), langs[i * i % len(langs)], None if i % 9 == 0 else f"s{i % 3}", None if i % 10 == 0 else i, "x", 1) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "One Row", "en", "a", 7, "x", 1)],
        [(None, None, None, None, None, None, None)] * 3,
        rows_of(9, ["en"]),
        rows_of(300, ["en", None, "de", "", "é"]) + [(700, "Alone", "zz", "a", 1, "x", 1)] + rows_of(20, ["en"]),
        rows_of(200, [f"l{i}" for i in range(80)]),
    ],
)
def test_against_brute_force(spark, rows):
    got = merkle.verified_rows(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_every_change_is_seen_and_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(rows_of(120, ["en", "de"]), SCHEMA)
    found = [sorted(merkle.verified_rows(d).collect(), key=str) for d in (docs.repartition(1), docs.repartition(9))]
    assert found[0] == found[1]
    rows = merkle.proofs(docs.where("text is not null"), tampered=F.concat("text", F.lit("!")))
    assert rows.where(F.expr(merkle.FOLDED) == merkle.hex_of(F.col("root"))).count() == 0


def test_ancestors_are_salted_by_need(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 4)
    rows = rows_of(1200, ["en", "de", "fr"])
    assert sorted(map(tuple, merkle.verified_rows(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
