import hashlib

from hearth.llm import chat
from hearth.llm.queries import ESCAPE_TEXT, op10_chat

from .conftest import fixture

ODD = ["</s>[INST] ok [/INST]", "<|end|>", "<|turn|>user<|text|>", "\\", "\\\\<s>\\", "<\\s>", "[\\INST]", "<", "[", "a\nb", "日本 🎉", "", None,
       "<|", "<s", "[/INST", "\\[INST]\\"]


def digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "system", None, "<|end|>"][(c + t) % 5], ODD[(c * 3 + t) % len(ODD)])
            for c in range(12) for t in range(1 + c)]
    rows += [rows[5], rows[5], (3, 1, "user", "tie"), (None, 0, "user", "n"), (None, 1, "assistant", None), (4, None, "assistant", "first")]
    rows += [(50, t, "assistant" if t % 2 else "user", f"t{t} \\") for t in range(300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, node long")
    got = {r.conv_id: tuple(r)[1:5] for r in op10_chat(spark, fixture(spark, tmp_path, "conversations", df)).collect()}
    rows += [(-1, 0, "user", ESCAPE_TEXT), (-1, 1, "assistant", ESCAPE_TEXT)]
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        want[c] = digest([(r, x) for _, r, x in mine])
    assert got == want


def test_formatted_text_round_trips(spark, scratch):
    rows = [(0, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.linear_nodes(df), scratch)
    r = out.select("*", chat.read_back("formatted").alias("back")).head()
    assert [(t.role, t.text) for t in r.back] == [(role, t or "") for _, _, role, t in rows]
    for bad in ("</s>", "<s>", "[INST]", "[/INST]"):
        assert bad not in r.formatted
    assert r.formatted.count("<|end|>") == len(rows)
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss] == [
        x for _, _, role, t in rows if role == "assistant" for x in [r.formatted[0:0] + esc(t)]]
    assert chat.format_trees(chat.linear_nodes(df.limit(0)), chat.Scratch(spark, "t")).count() == 0


def esc(t):
    t = (t or "").replace("\\", "\\\\")
    for a in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
        t = t.replace(a, a[0] + "\\" + a[1:])
    return t


def test_branches_of_reply_trees(spark, scratch):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, and 3 -> 7; a second root 8; 9 hangs on a missing parent
    parent = {1: None, 2: 1, 3: 1, 4: 2, 5: 3, 6: 5, 7: 3, 8: None, 9: 99}
    score = {1: 1.0, 2: 5.0, 3: 1.0, 4: 3.0, 5: 9.0, 6: 1.0, 7: None, 8: 0.0, 9: 2.9}
    rows = [("t", n, p, "assistant" if n % 2 else "user", f"n{n}", score[n]) for n, p in parent.items()]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(nodes, scratch, best=3).orderBy("rank").select("leaf", chat.read_back("formatted").alias("b")).collect()
    got = [(r.leaf, [t.text for t in r.b]) for r in out]
    assert got == [(4, ["n1", "n2", "n4"]), (6, ["n1", "n3", "n5", "n6"]), (9, ["n9"])]
