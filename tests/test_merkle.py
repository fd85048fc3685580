"""The stored Merkle log against a plain recomputation, for every size; proofs that a log was only appended to; signed heads."""

from __future__ import annotations

import collections
import hashlib
import hmac

import pytest

from brinewatch.operators import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves):
    level = list(leaves)
    while len(level) > 1:
        level = [sha(level[i] + (level[i + 1] if i + 1 < len(level) else level[i])) for i in range(0, len(level), 2)]
    return level[0]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    leaves = [sha(f"record {i}") for i in range(600)]
    out = merkle.Log(spark, str(tmp_path_factory.mktemp("log") / "nodes"))
    at = 0
    for n in (1, 7, 62, 300, 230):
        out = out.append(spark.createDataFrame([(i, leaves[at + i]) for i in range(n)], "i long, h string"))
        at += n
    return out, leaves


def test_stored_nodes_are_the_perfect_ones(log):
    out, leaves = log
    got = {(r.level, r.i): r.h for r in out.nodes().distinct().collect()}
    want, level, k = {}, leaves, 0
    while level:
        want |= {(k, i): h for i, h in enumerate(level)}
        level, k = [sha(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)], k + 1
    assert got == want and out.nodes().count() == len(want)


def test_roots_of_all_sizes(spark, log):
    out, leaves = log
    sizes = [*range(1, 71), 255, 256, 257, 511, 512, 513, 600]
    got = {r["size"]: r.root for r in out.roots(spark.createDataFrame([(m,) for m in sizes], "size long")).collect()}
    assert got == {m: plain_root(leaves[:m]) for m in sizes}


def test_consistency_of_all_old_sizes(spark, log):
    out, leaves = log
    sizes = [*range(1, 71), 256, 300, 511, 512, 599, 600]
    proofs = collections.defaultdict(dict)
    for r in out.consistency(spark.createDataFrame([(m,) for m in sizes], "size long")).collect():
        proofs[r.old_size][r.level, r.i] = r.h
    root = plain_root(leaves)
    rewritten = ["0" * 64, *leaves[1:]]
    for m in sizes:
        assert len(proofs[m]) <= 30 and merkle.consistent(proofs[m], m, plain_root(leaves[:m]), 600, root)
        assert not merkle.consistent(proofs[m], m, plain_root(rewritten[:m]), 600, root) and not merkle.consistent(proofs[m], m, plain_root(leaves[:m]), 600, plain_root(rewritten))
        some = sorted(proofs[m])[0]
        assert not merkle.consistent({k: v for k, v in proofs[m].items() if k != some}, m, plain_root(leaves[:m]), 600, root)


def test_an_append_that_runs_again_changes_nothing(spark, tmp_path):
    log = merkle.Log(spark, f"{tmp_path}/nodes").append(spark.createDataFrame([(i, sha(str(i))) for i in range(5)], "i long, h string"))
    more = spark.createDataFrame([(i, sha(str(5 + i))) for i in range(6)], "i long, h string")
    log.append(more)
    again = log.append(more)
    assert again.roots(spark.createDataFrame([(11,)], "size long")).first().root == plain_root([sha(str(i)) for i in range(11)])


def test_heads_chain_their_signatures(spark):
    heads = spark.createDataFrame([(d, 10 * d, sha(str(d))) for d in (3, 1, 2)], "day long, tree_size long, root string")
    rows = sorted(merkle.signed(heads).collect())
    last = None
    for r in rows:
        assert r.previous == last
        last = hmac.new(merkle.KEY, merkle.payload(r.root, r.tree_size, (r.day + 1) * 86400.0, last), hashlib.sha256).hexdigest()
        assert r.signature == last
    table = merkle.signed(heads)
    assert merkle.head_errors(table, 1e9).collect() == []
    assert {(r.day, r.error) for r in merkle.head_errors(table.where("day != 2"), 1e9).collect()} == {(3, "BROKEN_LINK")}
    assert {r.error for r in merkle.head_errors(table, 0.0).collect()} == {"FUTURE"}
