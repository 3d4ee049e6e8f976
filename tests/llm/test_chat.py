import hashlib
import json
from itertools import groupby

from pyspark.sql import Row

from ledgerline.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string, start long, number long, window long, cut string"
TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\0\\1 \\\\1", "<\\/s> [\\INST]", "<s>[ROLE]assistant[TEXT]x</s>", "<<SYS>>a<</SYS>>", None, "", "日本 \U0001f600 words here", "a b c " * 40, "w " * 700]


def conversations(spark):
    rows = []
    for c in range(6):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * (3 + 5 * c)
        rows += [Row(c, t, role, TEXTS[(t * 7 + c) % len(TEXTS)], 1, 1, 1, "x") for t, role in enumerate(roles)]
    rows += [Row(None, 0, "user", "no id", 1, 1, 1, "x"), Row(None, None, "assistant", "no turn", 1, 1, 1, "x"), Row(7, 300, "assistant", "late", 1, 1, 1, "x"), Row(7, 2, "user", "early", 1, 1, 1, "x"), Row(8, 0, None, "role", 1, 1, 1, "x")]
    rows += [Row(9, 0, "assistant", "same", 1, 1, 1, "x")] * 2
    return spark.createDataFrame(rows, SCHEMA)


def ordered(rows):
    key = lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role or "", r.text or "")
    return {c: list(g) for c, g in groupby(sorted(rows, key=key), key=lambda r: r.conv_id)}


def test_windows_hold_each_turn_once_and_stay_in_budget(spark):
    source = conversations(spark)
    made = cw.windows(source, budget=120, history=30).cache()
    back = cw.read_turns(made).collect()
    for conv, turns in ordered(source.collect()).items():
        mine = sorted((r for r in back if r.conv_id == conv and not r.repeated), key=lambda r: r.number)
        assert [(r.role, r.text) for r in mine] == [(t.role or "", t.text or "") for t in turns], conv
        assert [r.target for r in mine] == [t.role == "assistant" for t in turns]
    cost = lambda text: len((text or "").strip(" ").split()) or 1
    for w in made.collect():
        assert w.formatted == "".join(w.formatted[p.start : p.end] for p in w.parts)
        assert not any(p.target and p.repeated for p in w.parts)
        if w.over_budget:
            assert any(p.end - p.start > 150 for p in w.parts)
        mine = [r for r in back if (r.conv_id, r.window) == (w.conv_id, w.window)]
        assert w.n_tokens == sum(cost(r.text) + cw.OVERHEAD for r in mine)
        if w.conv_id in (1, 3, 5):
            assert w.parts[0].number == 0
        for text in (p for p in w.formatted.split(cw.BEGIN + cw.MIDDLE)[1:]):
            assert not any(x in text[: -len(cw.END)].replace(cw.TEXT, "", 1) for x in cw.CONTROLS)


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t or "",) for t in TEXTS + ["[TEXT]", "\\1<s>", "<\\1s>", "\\\\0"]], "t string")
    rows = df.select("t", cw.escape(df.t).alias("e")).select("t", "e", cw.unescape(cw.F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in rows)


def test_digests(spark, tmp_path):
    conversations(spark).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in cw.op2_chat_windows(spark, str(tmp_path)).collect()}
    want = ordered(conversations(spark).collect())
    want[-1] = [Row(role="user", text=cw.TRICKY), Row(role="assistant", text=cw.TRICKY)]
    assert set(got) == set(want)
    for c, turns in want.items():
        whole = "".join(f"{t.role or ''}\n{t.text or ''}\n" for t in turns)
        loss = "".join(t.text or "" for t in turns if t.role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), json.dumps(str(c))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    assert cw.windows(spark.createDataFrame([], SCHEMA)).count() == 0
