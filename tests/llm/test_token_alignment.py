"""Alignment against the libraries on whole texts and a plain intersection of ends."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from sparkwarden.llm import token_alignment as m

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(BYTE[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        sides = self.tokens(text)
        ends = [np.cumsum([len(x) for _, x in s]).astype(int).tolist() for s in sides]
        out = {e: ([], []) for e in sorted(set(ends[0]) & set(ends[1]))}
        cuts = list(out)
        for k, (s, e) in enumerate(zip(sides, ends)):
            for (i, _), end in zip(s, e):
                out[next(c for c in cuts if c >= end)][k].append(i)
        return out

    def rows(self, texts):
        all_groups = [list(self.groups(t).values()) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in all_groups]
        count, best = Counter(p for c in links for p in c), defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for g, c in zip(all_groups, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
            yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), digest)


def some_texts():
    rng = random.Random(4)
    bits = ["word", " ", "  ", "\n", "\n ", " \n", "\t", "'s", "don't", "é", " ", "　", " ", "   ", "日本", "🙂", "123", "...", "<|endoftext|>", "<s>", "</s>", "ouèle", "x" * 30, "    ", "\r\n", "\x00", "\x85", "Ünï"]
    made = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(250)]
    return [None, "", " ", "  a", "▁ piece", "a▁b", "a" * 3000, "é" * 500, "x y " * 4000, "\n\n  two", *made, made[0], made[0]]


def test_against_libraries(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    want = [(i, *r) for i, r in enumerate(Plain().rows(texts))]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for pairs in (m.BLOCK_PAIRS, 40):
        assert sorted(map(tuple, m.align(df, A, B, block_pairs=pairs).select(names).collect())) == want
    assert m.align(df.limit(0), A, B).count() == 0


def test_groups(spark):
    texts = some_texts()[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {g.end: (list(g.a), list(g.b)) for g in r.groups} for r in m.groups(df, A, B).collect()}
    plain = Plain()
    assert got == {i: plain.groups(t) for i, t in enumerate(texts)}


def test_diagonal_runs():
    rng = np.random.default_rng(1)
    for n in [1, 2, 5, 50, 3000] * 20:
        a, b = (np.flatnonzero(rng.random(n) < p) for p in (rng.random(), rng.random()))
        a, b = (np.unique(np.append(x, n)) for x in (a, b))
        common = np.intersect1d(a, b)
        got = m.group_ends(a, b)
        assert (a[got[0]] == common).all() and (b[got[1]] == common).all()


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(m, "CACHE_UNITS", 3)
    two = m.Pair(A, B)
    for text in ["one two three four five", "two six seven one", "one two three four five", "eight two"]:
        raw = text.encode()
        x = m.Aligned(two, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        plain = Plain().tokens(text)
        assert [i.tolist() for i in x.ids] == [[i for i, _ in side] for side in plain]
