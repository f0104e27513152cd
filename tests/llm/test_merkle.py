import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dragoman.llm import merkle

from .conftest import SCHEMA


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_tree(nodes, fan):
    """Root, and every leaf's siblings with its slot, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % fan : a - a % fan + fan]
            paths[i].append((run[: a % fan], run[a % fan + 1 :]))
        nodes = [h("".join(nodes[a : a + fan])) for a in range(0, len(nodes), fan)]
        at = [a // fan for a in at]
    return nodes[0], paths


def slow_manifest(rows, fan, found):
    """(doc_id, leaf, subroot, root, siblings, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops, lower = [], {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        root, paths = slow_tree([x[2] for x in trees[s]], fan)
        tops.append(root)
        lower[s] = paths
    root, upper = slow_tree(tops, fan)
    out = []
    for s, top, above in zip(names, tops, upper, strict=True):
        for (_, _, leaf, r), path in zip(trees[s], lower[s], strict=True):
            node = h("".join(map(field, found(r))))
            for before, after in path + above:
                node = h("".join([*before, node, *after]))
            out.append((r[0], leaf, top, root, h("".join(d for b, a in path + above for d in b + a)), node))
    return sorted(out, key=str)


def tampered(r):
    text = r[4]
    if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return (*r[:4], text)


def shown(out):
    digests = [merkle.as_text(F.col(c)) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(merkle.as_text(merkle.proof(F.col("path"))).cast("binary"), 256)
    return sorted((tuple(r) for r in out.select("doc_id", *digests, proof, merkle.as_text(F.col("folded_root"))).collect()), key=str)


def lower():
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fifth():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_awkward_rows(docs, awkward, fan):
    clash = docs.withColumns({c: F.lit("x") for c in ("tree", "id", "digest", "found", "n", "at", "run", "path", "range", "row", "level")})
    got = shown(merkle.manifest(clash, fan=fan, audited={"text": lower()}, where=fifth()))
    assert got == slow_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in awkward], fan, tampered)


def test_tampering_is_told(spark):
    rows = [(i, "one" if i % 3 else None, "aa", i, f"Text {i}") for i in range(1000)] + [(5, "lone", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, audited={"text": F.concat("text", F.lit("!"))}, where=F.col("doc_id") % 100 == 7)
    changed = {r[0] for r in out.filter("folded_root <> root").select("doc_id").collect()}
    assert changed == set(range(7, 1000, 100))
    assert shown(out) == slow_manifest(rows, 16, lambda r: (*r[:4], r[4] + "!") if r[0] % 100 == 7 else r)
    plain = merkle.manifest(docs)
    assert plain.filter("folded_root = root").count() == len(rows)


def test_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    leaf = h("-----")
    assert shown(merkle.manifest(one)) == [(None, leaf, leaf, leaf, h(""), leaf)]
    assert merkle.manifest(empty).count() == 0


def test_equal_rows_of_a_hot_group(spark):
    rows = [(1, "hot", "aa", 4, "same")] * 300 + [(i, "hot", "aa", 4, f"t{i}") for i in range(40)] + [(i, f"s{i}", "aa", 1, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA.split(", size")[0].replace("text string, lang string, source string, n_chars long", "source string, lang string, n_chars long, text string"))
    assert shown(merkle.manifest(docs)) == slow_manifest(rows, 16, lambda r: r)
