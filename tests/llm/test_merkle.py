"""The manifest against a plain recursion over lists; continued manifests; edge cases."""

import hashlib
import random
import zlib

import pytest

from sparkwarden.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _at int"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(r) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, str]]]]:
    """The root and each node's way, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            ways[i].append((k % 16, "".join(run[: k % 16] + run[k % 16 + 1 :])))
        nodes, at = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], ways


def plain(rows) -> list[tuple]:
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    names, subs, ways, order = sorted(groups), [], {}, {}
    for g in names:
        order[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        sub, ways[g] = tree([plain_leaf(r) for r in order[g]])
        subs.append(sub)
    root, upper = tree(subs)
    out = []
    for g, sub, up in zip(names, subs, upper):
        for r, way in zip(order[g], ways[g]):
            low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            fold = plain_leaf((*r[:4], low)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else plain_leaf(r)
            for at, others in way + up:
                fold = h(others[: 64 * at] + fold + others[64 * at :])
            out.append((r[0], plain_leaf(r), sub, root, h("".join(o for _, o in way + up)), fold, fold == root))
    return sorted(map(str, out))


def made(manifest) -> list[str]:
    rows = merkle.verify(merkle.witnesses(manifest)).collect()
    return sorted(str((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in rows)


def some(n: int, first: int = 0) -> list[tuple]:
    rng = random.Random(n)
    return [(first + i, rng.choice(["a", "b", "é", "", None, "a", "a"]), rng.choice(["en", None]), i, rng.choice(["Text A", "low", "", None, "É" * 500])) + ("x", 1) for i in range(n)]


@pytest.mark.parametrize("n", [1, 16, 17, 700])
def test_against_lists(spark, n):
    rows = some(n) + ([(5, "a", "en", 1, "Same", "x", 1)] * 2 + [(None, "a", None, None, None, None, None), (5, "a", "en", 1, "Another", "x", 1)] if n == 17 else [])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(merkle.build(df, other=merkle.lower_cased())) == plain(rows)


def test_sources_of_one_row_and_many_sources(spark):
    rows = [(i, f"s{i % 300}", None, 1, "A") for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(merkle.build(df, other=merkle.lower_cased())) == plain(rows)
    assert merkle.witnesses(merkle.build(df.limit(0))).count() == 0


def test_continued(spark):
    first = [(i, "a", "en", 1, f"T{i}") for i in range(300)] + [(i, "b", "en", 1, "B") for i in range(20)] + [(i, "d", "en", 1, "B") for i in range(256)]
    more = [(i, "a", "en", 1, f"T{i}") for i in range(300, 800)] + [(3, "c", "en", 1, "C"), (900, "d", None, None, None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    held = merkle.build(spark.createDataFrame(first, schema), other=merkle.lower_cased())
    grown = merkle.build(spark.createDataFrame(more, schema), other=merkle.lower_cased(), earlier=held)
    assert made(grown) == plain(first + more)
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([(19, "b", None, None, None)], schema), earlier=held)


def test_frontier_extends_what_is_below():
    nodes = [h(str(i)) for i in range(37)]
    f = merkle.Frontier()
    for i, x in enumerate(nodes):
        f.append(x)
        assert [len(w) for w in f.witnesses] == [1 if k < (i + 1) // 16 * 16 else 0 for k in range(i + 1)]
    root = f.close()
    assert (root, f.witnesses) == tree(nodes) and all(merkle.folded(x, w) == root for x, w in zip(nodes, f.witnesses))
