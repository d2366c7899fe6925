from sparkwarden.llm.chat_format import preference_pairs, swapped_replies

SCHEMA = "pair_id long, turn long, role string, text string, _turns int"


def brute(chosen, rejected):
    def turns(rows):
        out = {}
        for p, n, r, t, _ in set(rows):
            out.setdefault(p, []).append((-1 if n is None else n, r or "user", t or ""))
        return {p: [x[1:] for x in sorted(v)] for p, v in out.items()}

    a, b, out = turns(chosen), turns(rejected), {}
    for p in a.keys() | b.keys():
        x, y = a.get(p, []), b.get(p, [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1

        def done(part):
            text, mask = "", []
            for role, t in part:
                text += f"<|{role}|>\n"
                if role == "assistant":
                    mask.append((len(text), len(text) + len(t) + 7))
                text += f"{t}<|end|>\n"
            return text, mask

        out[p] = (n, done(x[:n])[0], *done(x[n:]), *done(y[n:]))
    return out


def test_cases(spark):
    talk = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", "more", 0), (1, 3, "assistant", "good", 0)]
    chosen = talk + talk[:1] + [(2, 0, "user", "a", 0), (3, 0, None, None, 0), (None, 0, "user", "null pair", 0), (5, None, "user", "x", 0)]
    rejected = talk[:3] + [(1, 3, "assistant", "bad é", 0), (3, 0, "user", "", 0), (4, 7, "assistant", "only here", 0), (None, 0, "user", "null pair", 0), (5, None, "user", "y", 0)]
    got = preference_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()
    mine = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask]) for r in got}
    assert mine == brute(chosen, rejected)
    assert mine[1][0] == 3 and mine[3][0] == 1


def test_long_conversation_comes_in_blocks(spark):
    chosen = [(1, 3 * i, "user" if i % 2 else "assistant", f"t{i}", 0) for i in range(300)]
    rejected = [(1, i, *t[2:]) for i, t in enumerate(chosen[:200])] + [(1, i, "assistant", f"r{i}", 0) for i in range(200, 310)]
    rows = sorted(preference_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect(), key=lambda r: r.block)
    want = brute(chosen, rejected)[1]
    assert [r.block for r in rows] == list(range(15)) and {r.n_prompt_turns for r in rows} == {200}
    whole = [sum((list(map(tuple, r[c])) if "mask" in c else [r[c]] for r in rows), []) for c in ("prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")]
    assert (*map("".join, whole[:2]), whole[2], "".join(whole[3]), whole[4]) == want[1:]


def test_one_turn_of_any_length(spark):
    row = [(1, 0, "assistant", "x" * 300000, 0)]
    r, = preference_pairs(spark.createDataFrame(row, SCHEMA), spark.createDataFrame(row[:0], SCHEMA)).collect()
    assert r.n_prompt_turns == 0 and len(r.chosen) == 300000 + 22 and [tuple(m) for m in r.chosen_mask] == [(14, 300021)]


def test_swapped(spark):
    df = spark.createDataFrame([(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2")], "conv_id long, turn long, role string, text string")
    chosen, rejected = swapped_replies(df)
    got = {r.pair_id: (r.n_prompt_turns, r.chosen, r.rejected) for r in preference_pairs(chosen, rejected).collect()}
    assert got == {0: (1, "<|assistant|>\na0<|end|>\n", "<|assistant|>\na1<|end|>\n"), 1: (1, "<|assistant|>\na1<|end|>\n", "<|assistant|>\na0<|end|>\n"), 2: (1, "<|assistant|>\na2<|end|>\n", "")}
    assert preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0
