"""Operators on small hand-made tables, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from uttera.operators import acoustic, adapters, batches, chat, checkpoints, inventory, mixing, neardup, panel, records, reference_pool, scoring, seeds, submission, validate


def test_confusion_and_scores(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a")], "gold string, pred string")
    s = scoring.scores(p).first()
    assert (s.accuracy, s.macro_f1, s.weighted_f1, s.scored) == (pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(4 / 9), 3)
    c = {r.label: (r.tp, r.fp, r.fn, r.support) for r in scoring.confusion(p).collect()}
    assert c == {"a": (1, 0, 1, 2), "b": (0, 1, 1, 1)}
    assert scoring.scores(p.limit(0)).first().accuracy is None


def test_manifest_gold(spark):
    r = spark.createDataFrame([("1", " "), ("2", "x"), ("3", None)], "id string, gold string")
    m = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("9", "z", 3)], "id string, intent string, seq int")
    assert {x.id: x.gold for x in scoring.with_manifest_gold(r, m).collect()} == {"1": "new", "2": "x", "3": None}


def test_quotas(spark):
    c = spark.createDataFrame([("set", 0), ("joke", 1), ("greet", 9), ("a", 39), ("b", 40), ("c", 149), ("d", 150)], "label string, n long")
    q = {r.label: r.quota for r in seeds.quotas(c, target=1190).collect()}
    assert q == {"set": 0, "joke": 20, "greet": 120, "a": 400, "b": 250, "c": 250, "d": 150}
    half = {r.label: r.quota for r in seeds.quotas(c, target=665).collect()}
    assert half["a"] == 200 and half["joke"] == 20


def test_plan(spark):
    q = spark.createDataFrame([("x", 50, True, True), ("y", 0, True, True), ("z", 10, False, False)], "intent string, quota int, has_seeds boolean, plain boolean")
    got = sorted((r.batch_id, r.n) for r in batches.batch_plan(q).collect())
    assert got == [("cov:x:0", 20), ("cov:x:20", 20), ("cov:x:40", 10), ("cov:z:0", 10), ("dis:x:0", 20), ("par:x:0", 20), ("par:x:20", 5)]
    done = spark.createDataFrame([("cov:x:0",)], "id string")
    assert batches.resume(batches.batch_plan(q), done, "batch_id").count() == 6


def test_positions(spark):
    r = spark.range(1000).select((F.col("id") * 7 + 3).alias("k")).orderBy(F.rand(1))
    got = sorted((x.k, x.position) for x in batches.positions(r, ["k"], 16).collect())
    assert got == [(i * 7 + 3, i) for i in range(1000)]


def test_shots(spark):
    plan = spark.createDataFrame([("b1", "x"), ("b2", "x")], "batch_id string, intent string")
    pool = spark.createDataFrame([("x", f"i{k}") for k in range(20)], "intent string, id string")
    got = batches.shots(plan, pool, k=3).collect()
    assert len(got) == 6 and len({(r.batch_id, r.id) for r in got}) == 6


def test_cascade(spark):
    rows = [
        ("1", 1, "نحب الطقس", "نحب <a> الطقس >", "i"), ("1", 2, "x", "x", "i"), ("2", 3, "مر", "مر <a> ", "i"), ("3", 4, "مر بنا", "مر لنا", "i"),
        ("4", 5, "مر بنا", "مر بنا", "no"), ("5", 6, "abc def", "abc def", "i"), ("6", 7, "كلمة", "كلمة", "i"), ("7", 8, None, "مر <a> بنا >", "i"), ("8", 9, None, None, "i"),
    ]
    items = spark.createDataFrame(rows, "id string, seq int, text string, annotated string, intent string")
    got = {r.id: (r.reject_reason, r.text) for r in validate.cascade(items, F.array(F.lit("a")), spark.createDataFrame([("i",)], "intent string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": None, "2": "format:unclosed", "3": "text_match", "4": "intent", "5": "arabic_ratio", "6": "length", "7": None, "8": "length"}
    assert got["7"][1] == "مر بنا"


def grams(s):
    s = "".join(s.split())
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


def py_greedy(items, gold):
    kept, out = {}, {}
    for k, seq, intent, t in sorted(items, key=lambda x: x[1]):
        g = grams(t)
        pool = [grams(x) for i, x in gold if i == intent] + kept.setdefault(intent, [])
        out[k] = not any(len(g & h) / len(g | h) >= 0.85 for h in pool)
        if out[k]:
            kept[intent].append(g)
    return out


def test_greedy(spark):
    r = random.Random(4)
    items, texts = [], []
    for k in range(300):
        if texts and r.random() < 0.6:
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice("abcdefgh")
            t = "".join(w)
        else:
            t = "".join(r.choices("abcdefgh ", k=r.randint(1, 60)))
        texts.append(t)
        items.append((str(k), k, r.choice("xy"), t))
    gold = [("x", texts[5]), ("y", "abc")]
    df = spark.createDataFrame(items, "id string, seq long, intent string, text string")
    got = {x.id: x.accepted for x in neardup.greedy(df, spark.createDataFrame(gold, "intent string, text string")).collect()}
    assert got == py_greedy(items, gold)
    assert neardup.greedy(df.limit(0)).count() == 0


def test_near_dup_chain(spark):
    """A~B and B~C but not A~C: A and C stay."""
    base = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRST"
    b, c = base[:-3] + "!?#", base[:-7] + "$%&*!?#"
    df = spark.createDataFrame([("A", 1, "x", base), ("B", 2, "x", b), ("C", 3, "x", c)], "id string, seq long, intent string, text string")
    want = py_greedy([("A", 1, "x", base), ("B", 2, "x", b), ("C", 3, "x", c)], [])
    assert {r.id: r.accepted for r in neardup.greedy(df).collect()} == want == {"A": True, "B": False, "C": True}


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    store, no_quantiles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, no_quantiles, None)
        return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


def test_near_dup_moves_few(spark):
    """Texts of the same words share pieces in many pairs that aren't similar; these aren't moved, and no text's pieces are."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(60)]
    items = [(str(k), k, "x", " ".join(r.choices(words, k=12))) for k in range(1500)]
    items += [(str(k), k, "x", items[k - 1500][3] + "!") for k in range(1500, 1550)]
    df = spark.createDataFrame(items, "id string, seq long, intent string, text string")
    gold = df.where("seq % 10 = 3").select("intent", "text")
    got = {}
    moved = shuffled(spark, lambda: got.update({x.id: x.accepted for x in neardup.greedy(df, gold).collect()}))
    assert got == {k: seq < 1500 and seq % 10 != 3 for k, seq, _, _ in items}
    assert moved < 12 * sum(len(x[3]) for x in items)


VERDICT = "seq int, item_id string, annotator string, annotator_pos int, derja string, natural string, intent_match boolean, slots_ok string, fixed_annotated string"


def test_panel(spark):
    rows = [
        (1, "i", "a", 1, "4", "3", True, "yes", None), (2, "i", "a", 1, "1", "1", False, "", None), (3, "i", "b", 2, "2", "5", True, "yes", None),
        (4, "j", "a", 1, "5", "5", True, "", "مر <a> بنا >"), (5, "j", "b", 2, "5", "5", True, "false", None), (6, "j", "c", 3, None, "5", True, "x", None),
        (7, "k", "a", 1, "4.7", "3", True, "x", None),
    ]
    v = spark.createDataFrame(rows, VERDICT)
    got = {r.item_id: (r.votes, r.of, r.keep) for r in panel.majority(v).collect()}
    assert got == {"i": (1, 2, False), "j": (1, 3, False), "k": (1, 1, True)}
    fixed = {r.item_id: (r.votes, r.keep, r.repaired, r.text) for r in panel.repair(v, F.array(F.lit("a")), ["a", "b", "c"]).collect()}
    assert fixed == {"i": (1, False, False, None), "j": (1, True, True, "مر بنا"), "k": (1, False, False, None)}
    assert panel.majority(v, ["a", "b", "c"]).where("item_id = 'k'").first().keep is False
    assert panel.verdict_map(v).count() == 3
    named = panel.verdict_map(v, ["a", "z"]).where("item_id = 'j'").first().per_annotator
    assert named["a"].derja == "5" and named["z"].derja is None and len(named) == 2


def test_panel_repair_by_the_first_annotator(spark):
    """Markup is also repaired where the majority stands; nobody repairs in place of the first annotator."""
    good, slots = (True, "yes", None), (True, "", "  مر   <a> بنا > ")
    rows = [(1, "stands", "a", 1, "5", "5", *slots), (2, "stands", "b", 2, "5", "5", *good), (3, "stands", "c", 3, "5", "5", *good),
            (4, "absent", "b", 2, "5", "5", *slots), (5, "absent", "c", 3, "5", "5", *good), (6, "other", "z", 9, "5", "5", *good),
            (7, "empty", "a", 1, "5", "5", True, "", ""), (8, "empty", "b", 2, "5", "5", *good), (9, "broken", "a", 1, "5", "5", True, "", "<q> x >"), (10, "broken", "b", 2, "5", "5", *good)]
    got = {r.item_id: (r.votes, r.keep, r.annotated) for r in panel.repair(spark.createDataFrame(rows, VERDICT), F.array(F.lit("a")), ["a", "b", "c"]).collect()}
    assert got == {"stands": (2, True, "مر <a> بنا >"), "absent": (1, False, None), "other": (0, False, None), "empty": (1, False, None), "broken": (1, False, None)}


def test_reference_pool(spark):
    rows = [("a", 1, 0.5), ("b", 2, 0.1), ("a", 3, 0.1), ("c", 4, None), ("d", 5, 0.9)]
    s = spark.createDataFrame(rows, "id string, seq int, wer double")
    assert [(r.pos, r.id) for r in reference_pool.reference_pool(s, most=0.15).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    assert [r.id for r in reference_pool.reference_pool(s, top=1, always=("d", "a")).orderBy("pos").collect()] == ["a", "d"]
    st = reference_pool.pool_stats(s).first()
    assert (st.n, st.least, st.median) == (3, 0.1, 0.1)


def test_acoustic(spark):
    clip = [0.5, -0.5] * 20 + [1.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, clip, "abcd"), (2, [], "x"), (3, [0.1], "x")], "id int, x array<float>, t string")
    m = {r.id: r for r in acoustic.measures(df, "x", 40, "t", frame=10).collect()}
    assert m[1].dur == pytest.approx(43 / 40) and m[1].activity == 1.0 and m[1].clip == pytest.approx(1 / 43)
    assert m[2].rms is None and m[3].activity is None
    ok = {r.id: r.ok for r in acoustic.measures(df, "x", 40, "t", frame=10).select("id", acoustic.gate().alias("ok")).collect()}
    assert ok == {1: True, 2: False, 3: False}


def test_ratio_cap(spark):
    train = spark.createDataFrame([("a",)] * 20 + [("b",)] * 3, "intent string")
    synth = spark.createDataFrame([(f"s{i}", "a" if i % 10 else ("b" if i % 20 else "c")) for i in range(200)], "ID string, intent string")
    got = mixing.ratio_cap(train, synth, ratio=2.0).collect()
    by = [r.intent for r in got]
    assert len(got) == 46 and by.count("b") == 10 and by.count("c") == 10
    assert mixing.ratio_cap(train, synth.limit(40), ratio=2.0).count() == 40


def test_renditions(spark):
    items = spark.createDataFrame([("x",), ("y",)], "id string")
    files = spark.createDataFrame([("aug/wav/x.wav",), ("aug/wav_ft/x.wav",), ("aug/wav_ft/y.wav",)], "path string")
    assert sorted(r.ID for r in mixing.renditions(items, files).collect()) == ["x", "x_ft", "y_ft"]


def test_submission(spark):
    df = spark.createDataFrame([("10-a", "set"), ("9-a", "quirk"), ("2-b", None), ("3-b", "zzz_q")], "id string, said string")
    known = spark.createDataFrame([("alarm_set",), ("quirk",), ("zzz_q",)], "label string")
    a = submission.abstain(df, "said", {"set": "alarm_set"}, "quirk", known, ("alarm",))
    assert {r.id: (r.hyp, r.rule) for r in a.collect()} == {"10-a": ("alarm_set", "keep"), "9-a": ("unknown", "catch_all"), "2-b": ("unknown", "unparseable"), "3-b": ("unknown", "out_of_scope")}
    assert [r.id for r in submission.by_number(a, "id").collect()] == ["2-b", "3-b", "9-a", "10-a"]


def test_chat(spark):
    rows = spark.createDataFrame([("u", "w.wav", "<a> v >", "x"), ("v", "w2.wav", None, " ")], "ID string, wav string, tun_slu_annotation string, intent string")
    prompts = spark.createDataFrame([("intent", "P"), ("slot_filling", "S")], "subtask string, prompt string")
    c = {(r.meta.id, r.meta.family, r.meta.subtask): [m.content for m in r.messages] for r in chat.records(rows, prompts).collect()}
    assert c == {("u", "qwen", "intent"): ["<audio>P", '{"intent": "x"}'], ("u", "gemma", "intent"): ["P<audio>", '{"intent": "x"}'], ("u", "qwen", "slot_filling"): ["<audio>", "<a> v >"], ("u", "gemma", "slot_filling"): ["S<audio>", "<a> v >"]}
    r = chat.reprompted(chat.records(rows, prompts, training=False), "N").collect()
    assert {m.messages[0].content for m in r} == {"<audio>N", "N<audio>", "<audio>"} and r[0].meta.split == "train_open"


def test_adapters(spark):
    t = [("base_model.model.q.lora_A.weight", 0, 0, 2.0), ("base_model.model.q.lora_A.weight", 0, 1, 3.0), ("base_model.model.q.lora_B.weight", 0, 0, 5.0), ("base_model.model.z.lora_A.weight", 0, 0, 1.0)]
    df = spark.createDataFrame(t, "key string, row long, col long, val double")
    d = adapters.deltas(df, alpha=32, rank=16)
    assert sorted((r.key, r.row, r.col, r.val) for r in d.collect()) == [("q.weight", 0, 0, 20.0), ("q.weight", 0, 1, 30.0)]
    assert [r.base for r in adapters.incomplete(df).collect()] == ["z.weight"]
    base = spark.createDataFrame([("q.weight", 0, 0, 1.0), ("p.weight", 0, 0, 1.0)], "key string, row long, col long, val double")
    assert {(r.key, r.val) for r in adapters.merged(base, d).collect()} == {("q.weight", 21.0), ("p.weight", 1.0)}
    assert adapters.unseen(base.where("key = 'p.weight'"), d).count() == 1


def test_checkpoints(spark):
    logs = spark.createDataFrame([("r", [(1, 0.5), (2, None), (3, 0.2), (4, 0.2)])], "run string, log_history array<struct<step: bigint, eval_loss: double>>")
    rows = checkpoints.log_rows(logs)
    assert checkpoints.best_steps(rows).first().step == 3
    assert checkpoints.best_steps(rows, spark.createDataFrame([("r", 1), ("r", 4)], "run string, step bigint")).first().step == 4


def test_records(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "id string, seq int, t string")
    assert {(r.id, r.t) for r in records.first_wins(df, "id", "seq").collect()} == {("a", "y"), ("b", None)}
    assert {(r.id, r.t) for r in records.last_wins(df, "id", "seq").collect()} == {("a", "x"), ("b", None)}
    assert records.last_n(df, "seq", 2).where("holdout").count() == 2
    tied = spark.createDataFrame([(f"i{k}", 1) for k in range(9)] + [("n", None)], "id string, seq int")
    assert sorted(r.id for r in records.last_n(tied, "seq", 3, ("id",)).where("holdout").collect()) == ["i6", "i7", "i8"]
    d = spark.createDataFrame([("2.5",), ("10.01",), ("x",), (None,)], "d string")
    assert d.where(records.duration_between(F.col("d"))).count() == 1 and d.where(records.duration_between(F.col("d"), keep_bad=True)).count() == 3


def test_inventory(spark):
    df = spark.createDataFrame([("<b> x > <a/b> <c-d> y >",), (None,)], "m string")
    assert [r.label for r in inventory.label_inventory(df, "m").collect()] == ["b", "c-d"]
    h = inventory.histogram(spark.createDataFrame([("x",), ("y",), ("x",)], "v string"), "v").collect()
    assert [(r.value, r.n) for r in h] == [("x", 2), ("y", 1)]


def test_funnel(spark):
    f = scoring.funnel([("a", spark.range(4)), ("b", spark.range(2)), ("c", spark.range(0))]).orderBy("pos").collect()
    assert [(r.stage, r.n, r.share) for r in f] == [("a", 4, None), ("b", 2, 0.5), ("c", 0, 0.0)]


def test_picks(spark):
    plan = spark.createDataFrame([("b1", "x", 30), ("b2", "z", 5)], "batch_id string, intent string, n int")
    pool = spark.createDataFrame([("x", k, f"c{k}") for k in range(4)], "intent string, pos int, item string")
    got = batches.picks(plan, pool).collect()
    assert len(got) == 30 and len({r.place for r in got}) == 30 and len({r.item for r in got}) > 1


def test_rarest_and_within(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), ("a",)], "v string")
    assert [r.value for r in inventory.rarest(df, "v", 2).collect()] == ["a", "y"]
    assert chat.within(spark.createDataFrame([("a b c",), ("a",)], "t string"), "t", 2).count() == 1


def test_seeds_all(spark):
    rows = spark.createDataFrame([(("x", "y")[k % 3 == 0], f"i{k:04d}") for k in range(900)], "intent string, id string")
    got = sorted(tuple(r) for r in seeds.seeds(rows, "intent", "id", []).collect())
    ids = {i: [f"i{k:04d}" for k in range(900) if (k % 3 == 0) == (i == "y")] for i in "xy"}
    assert got == [(i, p, v) for i in "xy" for p, v in enumerate(ids[i])]


def test_slots_of_validation(spark, tmp_path):
    from uttera.plans import catalogue

    cols = "id string, split string, intent string, tun_slu_annotation string"
    rows = [("a1", "train", "x", "<l> v >"), ("a2", "validation", "x", "<m> w >"), ("a3", "validation", "x", "<m> w >"), ("a4", "test", "x", "<n> u >"), ("a5", "validation", "y", "t")]
    for name, got in (("train", rows[:1]), ("heldout", rows[1:])):
        spark.createDataFrame(got, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(r) for r in catalogue.slot_values(spark, str(tmp_path)).collect()} == {("l", "v"), ("m", "w")}
    assert {(r.intent, *r.combo, r.n, r.rank) for r in catalogue.slot_combinations(spark, str(tmp_path)).collect()} == {("x", "m", 2, 1), ("x", "l", 1, 2), ("y", 1, 1)}


def test_shots_offer_all(spark):
    plan = spark.range(300).select(F.concat(F.lit("b"), "id").alias("batch_id"), F.lit("x").alias("intent")).unionByName(spark.createDataFrame([("c", "y")], "batch_id string, intent string"))
    pool = spark.createDataFrame([("x", f"i{k}") for k in range(200)] + [("y", "j0"), ("y", "j1")], "intent string, id string")
    got = [tuple(r) for r in batches.shots(plan, pool, k=6).collect()]
    assert len({r[1] for r in got if r[0] != "c"}) > 190  # 64 at most with a cap
    assert len(got) == len({r[:2] for r in got}) == 1802 and {r[1] for r in got if r[0] == "c"} == {"j0", "j1"}
