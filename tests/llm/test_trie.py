import hashlib
import random
import re
import zlib
from collections import defaultdict

from hearth.llm import trie
from hearth.llm.queries import op13_prefix_trie

from .conftest import fixture

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, path string"


def brute(rows):
    """Nodes of the contract by plain dictionaries."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, mine in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = (own.get(base, [])[:h] if base is not None else []) + mine[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[:d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0

    def under(k):
        todo, out = [k], []
        while todo:
            out.append(todo.pop())
            todo += kids.get(out[-1], ())
        return out

    out = []
    for k, v in members.items():
        sub = under(k)
        ids = ",".join("" if c is None else str(c) for c in sorted(ends.get(k, ()), key=lambda c: (c is not None, c or 0)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), len(kids.get(k, ())), sum(not kids.get(x) for x in sub),
                    sum((len(members[x]) - 1) * words(x) for x in sub), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, folder, rows):
    df = spark.createDataFrame([(*r, "k", 7, "p") for r in rows], SCHEMA).repartition(5)
    out = op13_prefix_trie(spark, fixture(spark, folder, "conversations", df))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "one two", "a b\x0bc", "  ", "x" * 50, "one", "hello there my friend"]
    rows = []
    for c in [*range(-25, 70), 100, 101, 5000, 9999]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a block without its first conversation
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(None, 0, "user", "hi"), (None, 1, None, None)]  # a conversation without a number
    rows += [rows[3], rows[3], (rows[4][0], rows[4][1], "user", "tie")]
    copy = [(t, "user", f"turn {t}") for t in range(30)]  # long copies and long conversations that differ late
    rows += [(c, *x) for c in range(200, 209) for x in copy]
    rows += [(c, *x) for c in range(220, 226) for x in copy[:20 + c % 7]] + [(c, 99, "assistant", f"end {c}") for c in range(220, 226)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_runs_of_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 4)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 20) for _ in (0,)] + [(c, 0, "user", "same") for c in range(1, 40)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_turnless_and_single(spark, tmp_path):
    single = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 == 2][:2]
    rows = [(c, 0, "user", "gone") for c in single]  # the head is absent and the only turn goes
    got = query(spark, tmp_path / "a", rows)
    assert got == brute(rows) and [r[1] for r in got] == [0]
    assert query(spark, tmp_path / "b", [(7, None, None, None)]) == brute([(7, None, None, None)])
    assert query(spark, tmp_path / "c", []) == []
