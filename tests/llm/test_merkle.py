import hashlib
import zlib
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F
from textquarry.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """(root, proof of each leaf as (left, right) steps) by plain recursion."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
    root, upper = tree([h(*run) for run in runs], arity)
    return root, [[("".join(run[:i]), "".join(run[i + 1:])), *upper[r]]
                  for r, run in enumerate(runs) for i in range(len(run))]


def brute(rows, arity):
    """rows of (doc_id, source, lang, n_chars, text); one result per row."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = [], []
    for name in names:
        own = sorted(groups[name], key=lambda g: g[:3])
        subroot, proofs = tree([g[2] for g in own], arity)
        subroots.append(subroot)
        found.append([(g[3], g[2], subroot, proof) for g, proof in zip(own, proofs)])
    root, upper = tree(subroots, arity) if subroots else (None, [])
    return [(row, own, subroot, root, proof + more) for members, more in zip(found, upper)
            for row, own, subroot, proof in members]


def check(spark, docs, rows, arity=3):
    found = merkle.verified(merkle.manifest(docs, arity=arity, presented=merkle.tampered())).select(
        "*", merkle.proof_digest(F.col("proof")).alias("digest")).collect()
    expected = []
    for row, own, subroot, root, proof in brute(rows, arity):
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        folded = leaf([*row[:4], row[4].replace("\n", "")]) if even and row[4] is not None else own
        for left, right in proof:
            folded = h(left, folded, right)
        expected.append((str(row[0]), own, subroot, root, h(*[a + b for a, b in proof]), folded, folded == root))
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["digest"], r["folded_root"],
                   r["verified"]) for r in found) == sorted(expected)
    return found


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, n) for k, s, lang, n, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_groups_of_all_sizes(spark, arity):
    rows = [(i, f"s{size}", "en" if i % 3 else None, i, f"a\nb {i}" if i % 2 else f"c {i}")
            for size in range(1, 12) for i in range(size * 100, size * 100 + size)]
    rows += [(9000 + i, None, None, None, None if i else "") for i in range(4)]
    found = check(spark, table(spark, rows), rows, arity)
    assert {r["verified"] for r in found} == {True, False}


def test_hot_source_and_repeated_rows(spark):
    rows = [(i // 2, "hot", "en", 3, f"t\n{i % 5}") for i in range(700)] + [(None, "hot", "de", 3, "x")] * 3
    check(spark, table(spark, rows), rows)


def test_awkward_documents(spark):
    docs = cases.awkward(spark).withColumn("group", F.lit("g")).withColumn("idx", F.lit(7)).withColumn("n", F.lit(1))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    check(spark, docs, rows)


def test_one_row_and_no_row(spark):
    rows = [(1, "é", None, None, "x")]
    assert check(spark, table(spark, rows), rows)[0]["proof"] == []
    assert merkle.manifest(cases.empty(spark)).count() == 0
