from pyspark.sql import functions as F

from checks import inputs
from loglens.operators import templates


def _fits(pattern: str, template: str) -> bool:
    p, t = pattern.split(), template.split()
    return len(p) == len(t) and all(b == "<*>" or a == b for a, b in zip(p, t))


def _mined(df):
    return sorted((r.line_id, r.event_id, r.template) for r in df.collect())


def test_every_line_fits_its_template(spark, sf_dir):
    logs = inputs.logs(spark, sf_dir).select("line_id", "content")
    mined = templates.mine_templates(logs)
    rows = logs.join(mined, "line_id").collect()
    assert len(rows) == logs.count()
    assert all(_fits(r.content, r.template) for r in rows)
    ids = mined.select("event_id", "template").distinct().collect()
    assert sorted(r.event_id for r in ids) == list(range(1, len(ids) + 1))


def test_result_does_not_depend_on_partitions_or_order(spark, sf_dir):
    logs = inputs.logs(spark, sf_dir).select("line_id", "content")
    assert _mined(templates.mine_templates(logs)) == _mined(
        templates.mine_templates(logs.repartition(7).orderBy(F.desc("line_id"))))


def test_merging_and_first_seen_ids(spark):
    lines = spark.createDataFrame(
        [(0, "open file alpha now"), (1, "close 17"), (2, "open file beta now"), (3, "open port gamma later on"),
         (4, "close 99"), (5, "open file gamma later")], "line_id bigint, content string")
    got = {r.line_id: (r.event_id, r.template) for r in templates.mine_templates(lines).collect()}
    assert got[0] == got[2] == got[5] == (1, "open file <*> <*>")
    assert got[1] == got[4] == (2, "close <*>")
    assert got[3] == (3, "open port gamma later on")


def _letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


def test_a_crowded_leaf_is_one_template(spark):
    """5,000 patterns of one leaf: the log and its first half get the same template and id."""
    rows = [(i, f"same {_letters(i)} rest of it") for i in range(5000)]
    whole = spark.createDataFrame(rows, "line_id bigint, content string")
    expected = {(1, "same <*> rest of it")}
    for lines in (whole, whole.where("line_id < 2500")):
        mined = templates.mine_templates(lines)
        assert {(r.event_id, r.template) for r in mined.select("event_id", "template").distinct().collect()} == expected
        assert mined.count() == lines.count()


def test_later_lines_keep_earlier_merges(spark):
    """Lines that are alike before the log grows are alike afterwards, under the same ids."""
    rows = [(i, f"{_letters(i % 7)} {_letters(i % 11)} {_letters(i % 5)} {_letters(i)} end") for i in range(600)]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    ids = [{r.line_id: r.event_id for r in templates.mine_templates(df).collect()} for df in (lines.where("line_id < 300"), lines)]
    assert all(ids[1][k] == v for k, v in ids[0].items())


def test_mining_keeps_columns_and_reads_lines_once(spark):
    lines = spark.createDataFrame([(0, "a 1", "x"), (1, "a 2", "y")], "line_id bigint, content string, node string")
    out = templates.with_mined_templates(lines)
    assert out.columns == ["line_id", "content", "node", "event_id", "template"]
    assert sorted((r.line_id, r.node, r.template) for r in out.collect()) == [(0, "x", "a <*>"), (1, "y", "a <*>")]


def test_few_first_tokens_keep_their_leaf(spark):
    lines = spark.createDataFrame([(i, f"head{chr(97 + i)} x y") for i in range(6)], "line_id bigint, content string")
    assert templates.mine_templates(lines).select("event_id").distinct().count() == 6
    assert templates.mine_templates(lines, max_children=3).select("event_id").distinct().count() == 3


def _mixed(n):
    """Lines of few templates, some with many values, and some of a kind of their own."""
    return [(i, [f"load {_letters(i)} from disk {_letters(i % 7)}", f"load all from net {_letters(i % 5)}", f"stop {_letters(i % 40)} {i}",
                 f"{_letters(i % 9)} {_letters(i % 13)} {_letters(i % 4)} odd", f"load {_letters(i % 3)} to disk now"][i * i % 5])
            for i in range(n)]


def test_parts_of_a_leaf_merge(spark):
    """A leaf in parts of 50 patterns: several tasks, the templates of one stream, whatever the partitions."""
    lines = spark.createDataFrame([(i, f"same {_letters(i)} rest of it") for i in range(2000)], "line_id bigint, content string")
    got = templates.mine_templates(lines, part_size=50)
    assert {(r.event_id, r.template) for r in got.select("event_id", "template").distinct().collect()} == {(1, "same <*> rest of it")}
    assert got.count() == 2000
    mixed = spark.createDataFrame(_mixed(1500), "line_id bigint, content string")
    one = _mined(templates.mine_templates(mixed, part_size=64))
    assert one == _mined(templates.mine_templates(mixed.repartition(5).orderBy(F.desc("line_id")), part_size=64))
    whole = {t for _, _, t in _mined(templates.mine_templates(mixed))}
    assert {t for _, _, t in one} & whole >= {"load <*> from <*> <*>"} & whole
    assert all(_fits(c.replace(str(i), "<*>"), t) for (i, c), (_, _, t) in zip(_mixed(1500), one))


def test_later_lines_keep_merges_of_parts(spark):
    mixed = spark.createDataFrame(_mixed(1500), "line_id bigint, content string")
    some, every = (_mined(templates.mine_templates(df, part_size=64)) for df in (mixed.where("line_id < 777"), mixed))
    assert [(k, e) for k, e, _ in some] == [(k, e) for k, e, _ in every[:777]]


def _steps(spark, lines, cuts, path, **more):
    """Mine lines in steps against a saved table."""
    known = templates.Mined.nothing(spark)
    df = spark.createDataFrame(lines, "line_id bigint, content string")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        new, known = templates.extend(known, df.where(f"line_id >= {a} AND line_id < {b}"), **more)
        assert new.where("event_id IS NULL").count() == 0
        known.save(f"{path}/{k}")
        known = templates.Mined.load(spark, f"{path}/{k}")
    return _mined(templates.with_stored_templates(known, df).select("line_id", "event_id", "template"))


def test_mining_in_steps_equals_mining_at_once(spark, tmp_path):
    lines = _mixed(900)
    df = spark.createDataFrame(lines, "line_id bigint, content string")
    for name, cuts, part in (("a", [300], 1 << 16), ("b", [1, 130, 131, 600], 64)):
        assert _steps(spark, lines, cuts, str(tmp_path / name), part_size=part) == _mined(templates.mine_templates(df, part_size=part))


def test_few_leaves_in_steps(spark, tmp_path):
    lines = [(i, f"head{chr(97 + i % 9)} x {_letters(i)}") for i in range(60)]
    df = spark.createDataFrame(lines, "line_id bigint, content string")
    assert _steps(spark, lines, [10, 30], str(tmp_path / "t"), max_children=4, part_size=16) == _mined(
        templates.mine_templates(df, max_children=4, part_size=16))


def test_stored_templates_leave_new_patterns_open(spark):
    _, known = templates.extend(templates.Mined.nothing(spark), spark.createDataFrame([(0, "a b 1")], "line_id bigint, content string"))
    got = templates.with_stored_templates(known, spark.createDataFrame([(5, "a  b 2"), (6, "other"), (7, None)], "line_id bigint, content string"))
    assert sorted((r.line_id, r.event_id, r.template) for r in got.collect()) == [(5, 1, "a b <*>"), (6, None, None), (7, None, None)]


def test_rare_tokens_find_what_all_tokens_find():
    """The index against a comparison with every template."""
    import random

    draw = random.Random(4)
    leaf = templates._Leaf(0.3)
    for i in range(1500):
        tokens = [draw.choice("abcdefghij"[: 2 + place]) if draw.random() < 0.9 else templates.WILDCARD for place in range(8)]
        want = {k: n for k, t in enumerate(leaf.templates) if (n := sum(x == y != templates.WILDCARD for x, y in zip(tokens, t))) >= 2.4}
        assert leaf._equal(tokens) == want
        leaf.add(tokens, i) if i % 3 else leaf.put(tokens, i)


def test_a_leaf_of_unlike_templates_is_small():
    """Prose founds a template for nearly every line; before, one of 14 tokens took over 4,000 bytes."""
    import random
    import tracemalloc

    draw = random.Random(1)
    rows = [" ".join(f"x{draw.randrange(10**9)}" for _ in range(14)) for _ in range(5000)]
    tracemalloc.start()
    leaf = templates._Leaf(0.3)
    for i, row in enumerate(rows):
        leaf.add(row.split(" "), i)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(leaf.line) == 5000 and used < 1200 * 5000


def test_large_line_ids_stay_exact(spark):
    """Numbers above 2^53 beside missing ones."""
    base = 2**60 + 1
    parts = [[(base + i, f"a b{chr(97 + i)} c") for i in range(k, k + 3)] for k in (0, 3)]
    known = templates.Mined.nothing(spark)
    for rows in parts:
        known = templates.extend(known, spark.createDataFrame(rows, "line_id bigint, content string"), part_size=2)[1]
    assert {r.line for r in known.patterns.collect()} == {base}


def test_prose_is_moved_to_be_mined_only(spark, monkeypatch):
    """Lines of rare words: what mining writes holds their texts less than four times (before: nine times)."""
    import os
    import random

    from loglens import session
    from loglens.operators import ranking

    draw = random.Random(3)
    rows = [(i, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40))) for i in range(3000)]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    written = []

    def staged(df, label):
        made = session.stage(df, label)
        written.append(sum(os.path.getsize(f.removeprefix("file:")) for f in made.inputFiles()))
        return made

    for module in (templates, ranking):
        monkeypatch.setattr(module, "stage", staged)
    mined = templates.mine_templates(lines, part_size=500)
    assert sorted((r.line_id, r.event_id, r.template) for r in mined.collect()) == [(i, i + 1, row) for i, row in rows]
    assert sum(written) < 4 * sum(len(row) for _, row in rows)


def test_prose_is_mined_without_a_step_for_each_token(monkeypatch):
    """A task over prose with some alike lines: what the rule gives line by line, in fewer Python calls than tokens (before: several a token)."""
    import random
    import sys

    import pyarrow as pa

    class Rows:
        """A partition that is here already."""
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, function, schema: function

    draw = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(draw.choice(common) if draw.random() < 0.3 else f"x{draw.randrange(10**9)}" for _ in range(50)) for _ in range(900)]
    for k in range(0, 900, 30):  # near copies
        words = texts[draw.randrange(k + 1)].split(" ")
        texts[k] = " ".join(w if draw.random() < 0.6 else f"y{draw.randrange(10**9)}" for w in words)
    want, founders = [], []
    for at, line in enumerate(texts):
        words = line.split(" ")
        same = [(sum(a == b for a, b in zip(words, t)), t.count(templates.WILDCARD), -k) for k, (t, _) in enumerate(founders)]
        n, _, k = max(same, default=(0, 0, 0))
        if n < 15:
            founders.append((words, at))
        else:
            founders[-k] = (templates.merge_tokens(founders[-k][0], words), founders[-k][1])
        want.append(founders[-k][1] if n >= 15 else at)
    assert 10 < 900 - len(founders) < 40
    batches = pa.table({"leaf": ["50 <*>"] * 900, "part": [0] * 900, "fresh": [True] * 900, "first_line": list(range(900)), "tokens": texts,
                        "line": [-1] * 900}).to_batches(max_chunksize=300)
    monkeypatch.setattr(templates, "_PIECE", 128)
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    task = templates._mine_parts(Rows(), 0.3, 1)
    sys.setprofile(count)
    try:
        made = list(task(iter(batches)))
    finally:
        sys.setprofile(None)
    rows = [r for batch in made for r in batch.to_pylist()]
    assert {r["line"]: r["founder"] for r in rows if r["kind"] == "member"} == dict(enumerate(want))
    assert {r["founder"]: r["tokens"] or r["first"] for r in rows if r["kind"] == "template"} == {at: " ".join(t) for t, at in founders}
    assert calls < 900 * 50, calls
