from quireflow.llm import preferences

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, pair STRING, a STRING, opening STRING"


def brute(rows, parts=preferences.PARTS):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    groups = {}
    for c in sorted(convs):
        groups.setdefault(convs[c][0], []).append(c)
    pairs, done = [], set()
    for g in groups.values():
        rest = []
        for p in range(parts):
            own = [c for c in g if c % parts == p]
            pairs += list(zip(own[::2], own[1::2], strict=False))
            rest += own[len(own) // 2 * 2 :]
        rest.sort()
        pairs += list(zip(rest[::2], rest[1::2], strict=False))
        done |= {rest[-1]} if len(rest) % 2 else set()
    render = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ts)

    def mask(ts):
        out, at = [], 0
        for r, x in ts:
            head = len(f"<|im_start|>{r}\n")
            if r == "assistant":
                out.append(f"{at + head}:{at + head + len(x) + len('<|im_end|>') + 1}")
            at += head + len(x) + len("<|im_end|>\n")
        return ",".join(out)

    out = []
    for a, b in pairs + [(c, None) for c in done]:
        x, y = convs[a], convs.get(b)
        if b is None:
            last = [k for k, (r, _) in enumerate(x) if r == "assistant"]
            n = last[-1] if last else len(x)
        else:
            n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        out.append((a, b, n, render(x[:n]), render(x[n:]), None if b is None else render(y[n:]), mask(x[n:]), None if b is None else mask(y[n:])))
    return sorted(map(repr, out))


def rows():
    out = []
    for c in range(41):
        opening = "Hello" if c % 3 else f"Own {c % 9}"
        out.append((c, 0, "user", opening))
        out.append((c, 1, "assistant", f"Reply {c % 4} é\U0001f600"))
        if c % 2:
            out += [(c, 2, "user", "More" * (c % 5)), (c, 3, "assistant", f"End {c}")]
    out += [(100, None, None, None), (100, 1, "assistant", "x"), (101, 0, "user", "no answer"), (102, 0, "user", "Hello"), (102, 1, "assistant", "Reply 0 é\U0001f600"), (103, 5, "user", "twice"), (103, 5, "user", "twice"), (None, 1, "user", "lost")]
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows()], SCHEMA)
    for parts in (256, 4):
        got = preferences.preferences(df.repartition(3), parts).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows(), parts)


def test_masks_hold_what_the_assistant_says(spark):
    for r in preferences.preferences(spark.createDataFrame([(*x, "", "", "") for x in rows()], SCHEMA)).collect():
        for m in filter(None, r.chosen_mask.split(",")):
            s, e = map(int, m.split(":"))
            assert r.chosen[s:e].endswith("<|im_end|>\n") and r.chosen[:s].endswith("assistant\n")


def test_empty(spark):
    assert preferences.preferences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = preferences.formatted(spark.createDataFrame([], "chosen_id LONG, rejected_id LONG, a ARRAY<STRUCT<turn: LONG, role: STRING, text: STRING>>, b ARRAY<STRUCT<turn: LONG, role: STRING, text: STRING>>"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
