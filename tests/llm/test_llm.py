"""Operators on text against brute force, small cases and held-out data."""

import glob
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import abuse, canonical_values, leaks, lookalikes, packing, segment_index, subjects, top_items


# --- top items -------------------------------------------------------------------------------------------------------
def test_top_items_like_a_sort(spark):
    rng = random.Random(1)
    data = [(rng.choice(["w1", "w2"]), rng.choice(["c", "d", None, " "]), rng.choice("xy"), rng.choice("abcdefgh"), rng.choice([1, 2, 2, 3, None]), rng.choice([1, 2, None]), 1) for _ in range(400)]
    df = spark.createDataFrame(data, "w string, c string, t string, n string, m long, u long, rank int")
    found = top_items.top_items(df, ["w", "c"], ["t", "n"], ["m", "u"], ["n", "t"], 3)
    best = {}
    for w, c, t, n, m, u, _ in data:
        if m is not None and c and c.strip():
            k = (w, c, t, n)
            best[k] = max(best.get(k, (-1, -1)), (m, -1 if u is None else u))
    expected = set()
    for g in {k[:2] for k in best}:
        rows = sorted((-v[0], -v[1], k[3], k[2]) for k, v in best.items() if k[:2] == g)
        expected |= {(*g, t, n) for _, _, n, t in rows[:3]}
    assert {(r["w"], r["c"], r["t"], r["n"]) for r in found.collect()} == expected
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert top_items.top_items(df.limit(0), ["w", "c"], ["t", "n"], ["m", "u"], ["n", "t"], 3).count() == 0


# --- look-alikes -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "stored,form,kinds",
    [
        ("plain", "plain", 0), ("ｆｕｌｌ", "full", 1), ("ﬁne", "fine", 1), ("café", "café", 2), ("wo​rd", "word", 4), ("a b", "a b", 8),
        ("сhаir", "chair", 16), ("Ѕolid", "Solid", 16), ("дома", "дома", 0), ("ευχαριστώ", "ευχαριστώ", 0), ("café", "café", 0), ("👩‍🔬", "👩‍🔬", 0),
        ("❤️", "❤️", 0), ("it’s — ok…", "it’s — ok…", 0), ("あり！", "あり！", 0), ("", "", 0), (None, None, 0), ("می‌خواهم", "می‌خواهم", 0),
        ("5 μm", "5 μm", 0), ("Ⓐcme", "Acme", 1), ("ℌello", "Hello", 1), ("x² ½ ™", "x² ½ ™", 0), ("Ⅷ", "VIII", 1), ("㎏", "kg", 1), ("ｶﾞﾗｽ", "ガラス", 1), ("ℹ️ ①", "ℹ️ ①", 0),
        ("օk", "ok", 16), ("Ꭺcme", "Acme", 16), ("ꓮcme", "Acme", 16), ("ɑpple", "apple", 16), ("əpɑl", "əpɑl", 0), ("ㅋㅋ น้ำ", "ㅋㅋ น้ำ", 0), ("Hуntra", "Hyntra", 16), ("Ηontrapla", "Hontrapla", 16), ("x" * 50_000 + "​", "x" * 50_000, 4),
    ],
)
def test_consistent_form(stored, form, kinds):
    assert lookalikes.PLAIN.form(stored) == (form, kinds)


def test_scores_and_disguised_words(spark):
    words = ["chair", "kettle", "stroller", "garden", "market", "summer", "battery", "leather", "marble", "shampoo"]
    df = spark.createDataFrame([(i, " ".join(words[i:] + words[:i]), "x") for i in range(10)], "id int, t string, form string")
    scores = lookalikes.script_scores(df.select("t"))
    assert scores.shape == (3, lookalikes.WIDTH, lookalikes.WIDTH, lookalikes.WIDTH)
    swap = {"a": "а", "e": "е", "o": "ο", "p": "р", "c": "с", "t": "т", "k": "к", "m": "м"}
    rng = random.Random(3)
    lattice = lookalikes.Lattice(scores)
    for w in words:
        hidden = "".join(swap[c] if c in swap and rng.random() < 0.6 else c for c in w)
        if hidden != w and any(c.isascii() for c in hidden):
            assert lattice.form(hidden)[0] == w
    out = lookalikes.consistent(spark.createDataFrame([(1, "сhair", "a"), (2, "chair", "b"), (3, None, "c")], "id int, t string, form string"), "t", ["id"], scores)
    assert [tuple(r) for r in out.collect()] == [(1, "chair", 16)]
    assert lookalikes.script_scores(df.limit(0).select("t")).shape[0] == 3


# --- abuse -----------------------------------------------------------------------------------------------------------
def test_disguises_are_taken_off():
    assert abuse.disguised_off("You are a P4TH3T1C l.o.s.e.r!!") == "you are a pathetic loser"
    assert abuse.disguised_off("stuuuupid t r a s h") == "stupid trash"


def test_held_out_patterns_are_told_apart():
    """Lines of kinds the classifier wasn't shown: every fifth pattern is left out of training."""
    from tidewatch.llm import abuse_labels as labels

    keep = lambda lines, k: [x for i, x in enumerate(lines) if (i % 5 == 0) == k]
    shown = [abuse.written_out(keep(lines, False), 12, 1, True) for lines in (labels.ABUSIVE, labels.HARMLESS)]
    hidden = [abuse.written_out(keep(lines, True), 4, 9, True) for lines in (labels.ABUSIVE, labels.HARMLESS)]
    model = abuse.fit([x[: abuse.WINDOW] for x in shown[0]], [x[: abuse.WINDOW] for x in shown[1]], rounds=3)
    model = abuse.fit(model.best(shown[0]), [x[: abuse.WINDOW] for x in shown[1]], rounds=4)
    abusive, harmless = model.scores(hidden[0]), model.scores(hidden[1])
    # of an abusive and a harmless line of unseen kinds the abusive one scores higher in nine of ten cases
    assert (abusive[:, None] > harmless[None, :]).mean() > 0.9


def test_scored_rows_with_nulls_long_and_repeated_texts(spark):
    model = abuse.trained(["the kettle is fine and i like it", "what a lovely lamp for the price"] * 5)
    bad = "you are a worthless idiot and everyone here knows it"
    data = [("1", bad), ("1", bad), ("2", "the kettle is fine"), ("3", None), ("4", ""), ("5", "a lovely lamp. " * 3000 + bad), ("6", "a lovely lamp. " * 3000)]
    df = spark.createDataFrame([(*d, 0.5) for d in data], "id string, t string, score double")
    out = {r["id"]: r for r in abuse.scored(df, ["id"], "t", model).collect()}
    assert [out[k]["flagged"] for k in "123456"] == [True, False, False, False, True, False]
    assert out["3"]["score"] is None and abuse.scored(df.limit(0), ["id"], "t", model).count() == 0


def test_a_flag_does_not_depend_on_the_other_posts(spark):
    model = abuse.kept_model(spark, ["the kettle is fine and i like it", "what a lovely lamp for the price"] * 5)
    data = [(str(i), f"you people sell number {i} and nobody here asked for it") for i in range(400)] + [("a", None), ("b", "what a lovely lamp")]
    posts = spark.createDataFrame(data, "id string, t string")
    scores = lambda df: {r["id"]: r["score"] for r in abuse.scored(df, ["id"], "t", model).collect()}
    every, part = scores(posts.repartition(7)), scores(posts.where("id in ('3', 'a', 'b')"))
    assert part["a"] is None and all(part[k] == pytest.approx(every[k]) for k in ("3", "b"))
    # the model is kept: the second time it is read, not fitted
    again = abuse.kept_model(spark, ["what a lovely lamp for the price", "the kettle is fine and i like it"] * 5)
    assert again.threshold == model.threshold and np.array_equal(again.weights, model.weights)


def test_threshold_between_held_out_lines():
    assert 0.2 < abuse.best_cut(np.array([0.1, 1.0, 2.0, 3.0]), np.array([-1.0, 0.0, 0.2])) <= 1.0
    assert abuse.best_cut(np.zeros(0), np.array([1.0])) == 0.0


def test_labelled_lines_are_not_taken_from_posts():
    """No run of four words of a line, however its slots are filled, stands in a post."""
    from tidewatch.llm import abuse_labels as labels

    word, rng, runs = re.compile(r"[a-z0-9']+"), random.Random(1), set()
    windows = lambda text: (lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)})(word.findall(text.lower()))
    for pattern in labels.ABUSIVE + labels.HARMLESS:
        for _ in range(300):
            runs |= windows(re.sub(r"\{(\w+)\}", lambda m: rng.choice(labels.SLOTS[m[1]]), pattern))
    met = set()
    for path in glob.glob("/root/testdata/sf*/*_posts.parquet"):
        for batch in pq.ParquetFile(path).iter_batches():
            for name in set(batch.schema.names) & {"title", "text", "title_clean", "text_clean"}:
                for text in set(batch.column(name).to_pylist()) - {None}:
                    met |= windows(text) & runs
    assert not met


# --- segment index ---------------------------------------------------------------------------------------------------
def _edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[k] = f"w{rng.randrange(9999)}"
        elif kind < 0.75:
            del out[k]
        else:
            out.insert(k, f"w{rng.randrange(9999)}")
    return out


def test_an_edited_text_keeps_a_segment():
    rng = random.Random(2)
    for _ in range(300):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(1, 220))]
        number = lambda ws: np.array([segment_index._numbers[w] for w in ws], np.uint64)
        other = _edited(rng, words, segment_index.EDITS)
        if other:
            assert np.isin(segment_index.segments(number(words)), segment_index.probes(number(other))).any()


def test_bounded_distance():
    assert segment_index.distance("a b c d".split(), "a x c d e".split(), 3) == 2
    assert segment_index.distance(["a"] * 9, ["b"] * 9, 3) == 4
    assert segment_index.same_post("a b c d e f g h i j".split(), "f g h i j a b c d e".split())
    assert not segment_index.same_post("a b c d e f g h".split(), "a b c x y z u v".split())


def test_rejected_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(segment_index, "HOT", 3)  # the standing introduction becomes a hot segment
    rng = random.Random(5)
    intro = "welcome to the weekly thread please read the rules before posting anything here thanks a lot everyone".split()
    fresh = lambda n: [f"v{rng.randrange(700)}" for _ in range(n)]
    history = [(f"h{i}", " ".join((intro if i % 2 else []) + fresh(rng.randint(20, 90)))) for i in range(60)]
    arrivals = []
    for i in range(1, 81):
        base = rng.choice(history + [(None, a[2]) for a in arrivals]) if i > 1 and rng.random() < 0.5 else None
        text = " ".join(_edited(rng, base[1].split(), rng.choice([0, 0.05, 0.1]))) if base else " ".join(intro + fresh(60))
        arrivals.append((i, rng.choice([f"a{i}", f"a{i}", "nan", None, " ", rng.choice(history)[0]]) if rng.random() < 0.3 else f"a{i}", text))
    arrivals += [(81, None, None), (82, "", ""), (83, "x", arrivals[0][2])]
    old = [(m, "t", x, f"hash{m}", "extra") for m, x in history] + [("h0", "t", history[0][1], "hashh0", "extra")]
    new = [(i, m, "t", x, None if i % 2 else f"n{i}", 7) for i, m, x in arrivals]
    h = spark.createDataFrame(old, "mention_id string, title_clean string, text_clean string, content_hash string, cid string")
    a = spark.createDataFrame(new, "arrival_id long, mention_id string, title_clean string, text_clean string, content_hash string, ord int")
    seen, known, expected = [x.split() for _, x in history], {m for m, _ in history}, set()
    for i, m, x in arrivals:
        words = (x or "").split()
        if (m and m.strip() and m != "nan" and m in known) or (words and any(segment_index.same_post(words, s) for s in seen)):
            expected.add(i)
        if m and m.strip():
            known.add(m)
        if words:
            seen.append(words)
    a = a.withColumn("batch_no", F.when(F.col("arrival_id") <= 30, 1).when(F.col("arrival_id") <= 60, 2).otherwise(3))
    assert {r["arrival_id"] for r in segment_index.rejected(h, a).collect()} == expected
    mixed = a.withColumn("batch_no", F.col("arrival_id") % 2)
    assert {r["arrival_id"] for r in segment_index.rejected(h, mixed).collect()} == expected
    assert segment_index.rejected(h, a.limit(0)).count() == 0
    assert {r["arrival_id"] for r in segment_index.rejected(h.limit(0), a.where("arrival_id in (1, 83)")).collect()} == {83}


def _index_and_batch(spark, old, new):
    """An index of texts, and signatures of others, both as lists of (number, words)."""
    history = [(str(i), "t", " ".join(w), f"h{i}") for i, w in old]
    index = segment_index.SegmentIndex.create(spark, spark.createDataFrame(history, "mention_id string, title_clean string, text_clean string, content_hash string"))
    batch = spark.createDataFrame([(i, " ".join(w), i) for i, w in new], "cid long, text string, ord long")
    cids = {r["cid"]: r["text"] for r in index.part("texts").collect()}
    number = {" ".join(w): i for i, w in old}
    return index, segment_index.signatures(batch, True), {c: number[t] for c, t in cids.items()}


@pytest.mark.parametrize("probes", [0, 500_000])
def test_pairs_with_a_fifth_of_the_words_replaced_meet(spark, monkeypatch, probes):
    monkeypatch.setattr(segment_index, "PROBES", probes)  # beyond it the index is shuffled instead
    rng = random.Random(21)
    old = [(i, [f"w{rng.randrange(2000)}" for _ in range(rng.choice([5, 10, 20, 40, 100]))]) for i in range(300)]
    new = []
    for i, words in old:
        places = rng.sample(range(len(words)), len(words) // 5)
        new.append((1000 + i, [f"x{i}" if k in places else w for k, w in enumerate(words)]))
    index, signed, number = _index_and_batch(spark, old, new)
    found = {(r["a"], number[r["b"]]) for r in index.candidates(signed).collect()}
    assert found >= {(1000 + i, i) for i in range(300)} and len(found) < 400


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2, 0.25])
def test_recall_of_edits(spark, share):
    """Words replaced, left out and added at random: all that the exact check takes for the same post meet in the index."""
    rng = random.Random(int(100 * share))
    old = [(i, [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 20, 40, 90, 200]))]) for i in range(200)]
    new = [(1000 + i, _edited(rng, w, share)) for i, w in old]
    index, signed, number = _index_and_batch(spark, old, new)
    met = {(r["a"], number[r["b"]]) for r in index.candidates(signed).collect()}
    same = {(1000 + i, i) for (i, w), (_, v) in zip(old, new, strict=True) if segment_index.same_post(w, v)}
    assert len(same) > 40 and same <= met


def test_a_repost_whose_intact_segments_are_all_hot_meets(spark, monkeypatch):
    monkeypatch.setattr(segment_index, "HOT", 3)
    monkeypatch.setattr(segment_index, "SALTED", 4)  # so the hot segments have several keys
    rng = random.Random(6)
    intro = [f"i{k}" for k in range(45)]
    old = [(i, [*intro, *(f"w{rng.randrange(5000)}" for _ in range(15))]) for i in range(40)]
    new = [(1000 + i, [f"x{i}" if k >= 45 and k % 2 else w for k, w in enumerate(words)]) for i, words in old]
    index, signed, number = _index_and_batch(spark, old, new)
    assert {(r["a"], number[r["b"]]) for r in index.candidates(signed).collect()} >= {(1000 + i, i) for i in range(40)}


def test_the_index_is_opened_again_and_the_history_is_not_read(spark, tmp_path):
    schema = "mention_id string, title_clean string, text_clean string, content_hash string"
    words = " ".join(f"w{k}" for k in range(40))
    path = str(tmp_path / "history")
    spark.createDataFrame([("m", "t", words, "h")], schema).write.parquet(path)
    home = segment_index.SegmentIndex.create(spark, spark.read.parquet(path), str(tmp_path / "index")).home
    import shutil

    shutil.rmtree(path)
    batch = lambda *rows: spark.createDataFrame(rows, f"arrival_id long, {schema}")
    found = []
    for name, rows in (("a", [(1, "x", "t", words.replace("w7 ", "z "), "h1")]), ("b", [(2, "y", "t", "quite another text", "h2"), (3, "y", "t", None, None)])):
        index = segment_index.SegmentIndex(spark, home)
        found += [tuple(r) for r in segment_index.admitted(index, name, batch(*rows)).collect()]
    assert found == [(1, "text"), (3, "id")]


# --- canonical values ------------------------------------------------------------------------------------------------
def test_mapped_values(spark):
    names = spark.createDataFrame(
        [("acmeria", "acmeria", None), ("dranirfy", "Dranirfy", ["drn"]), ("dranerfy", "Dranerfy", []), ("zykaefoulk works", "Zykaefoulk Works", ["", None, " ", "Zyka"])],
        "brand_norm string, brand_display string, aliases array<string>",
    )
    typed = {
        "ACMERIA™": "acmeria", "  acmeria's ": "acmeria", "the Acmeria official store": "acmeria", "acmreia": "acmeria", "DRN": "dranirfy", "drm": None, "dranirfy": "dranirfy",
        "dranrfy": None, "works zykaefoulk": "zykaefoulk works", "Zykaefoulk-Works LLC": "zykaefoulk works", "ZykaefoulkWorks": "zykaefoulk works", "blue kettle": None,
        "Асmeria": "acmeria", "x" * 5000: None, "!!!": None,
    }
    values = spark.createDataFrame([(v, 1.0, "e") for v in [*typed, None, " ", "DRN"]], "value string, score double, entry string")
    found = {r["value"]: r["entry"] for r in canonical_values.mapped(values, canonical_values.names_of(names)).collect()}
    assert {v: found.get(v) for v in typed} == typed
    assert canonical_values.mapped(values, canonical_values.names_of(names.limit(0))).where("entry is not null").count() == 0
    assert canonical_values.mapped(values.limit(0), canonical_values.names_of(names)).count() == 0


def test_edits_like_the_table_of_all_prefixes():
    def table(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(12)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        assert canonical_values.distance(a, b, 4) == min(table(a, b), 5)
    assert canonical_values.distance("x" * 5000, "x" * 4998 + "yz", 4) == 2


def test_the_two_best_names_of_all():
    """Whatever the cosine's order, the two best scores are those of all names with a common n-gram."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcde", k=rng.randint(5, 9))) for _ in range(200)]
    names = sorted(set(names))
    index = canonical_values.Index(names, names, {}, 1.0)
    for value in ["".join(rng.choices("abcde", k=7)) for _ in range(60)]:
        own = set(canonical_values.grams([value]))
        every = []
        for name in names:
            other = set(canonical_values.grams([name]))
            if own & other:
                cosine = len(own & other) / (len(own) * len(other)) ** 0.5
                every.append((cosine + 1 - canonical_values.distance(value, name, 4) / max(len(value), len(name))) / 2)
        if value not in names:
            assert [o[1] for o in index.best(value)] == pytest.approx(sorted(every)[:-3:-1])


def test_several_blocks_of_names_like_one(spark, monkeypatch):
    rng = random.Random(8)
    made = ["".join(rng.choices("abcdefgklmnoprstuvyz", k=9)) for _ in range(60)]
    names = spark.createDataFrame([(n, n) for n in made], "entry string, name string")
    values = spark.createDataFrame([(n[:4] + n[5:],) for n in made], "value string")
    one = {(r["value"], r["entry"]) for r in canonical_values.mapped(values, names).collect()}
    monkeypatch.setattr(canonical_values, "BLOCK", 16)
    assert {(r["value"], r["entry"]) for r in canonical_values.mapped(values, names).collect()} == one


# --- packing ---------------------------------------------------------------------------------------------------------
def _least(sizes, capacity):
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b >= rest[0]}.values():
            go(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1 :]])
        go(rest[1:], [*bins, capacity - rest[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_plan_holds_every_item_and_is_near_the_least():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        made = packing.plan(Counter(sizes), 20)
        assert all(sum(p) <= 20 for p, _ in made)
        assert Counter(s for p, n in made for s in p for _ in range(n)) == Counter(sizes)
        assert sum(n for _, n in made) <= _least(sizes, 20) + 1


def test_reduction_goes_on_after_an_unproven_item():
    # 9 isn't proven (9 + 4 + 3 + 2 leaves much open), the exact complement of 12 and the pair of 10 are
    made = packing.plan({12: 1, 8: 1, 9: 1, 4: 1, 3: 1, 2: 1}, 20)
    assert ((12, 8), 1) in made and sum(n for _, n in made) == 2
    items = packing._Items({11: 1, 6: 1, 5: 1, 3: 1}, 20)
    assert packing.dominant(items, 11, 20) == (11, 6, 3) and packing.dominant(packing._Items({15: 1, 9: 1}, 20), 15, 20) == (15,)
    rng = random.Random(3)
    for _ in range(150):
        counts = Counter(rng.randint(3, 20) for _ in range(rng.randint(3, 9)))
        items = packing._Items(counts, 20)
        for size in sorted(counts):
            if found := packing.dominant(items, size, 20):
                rest = counts - Counter(found)
                # fixing a proven set loses no optimum
                assert 1 + _least(list(rest.elements()), 20) == _least(list(counts.elements()), 20)


def test_best_fit_of_many_alike():
    made = packing.plan({7: 1_000_000, 5: 3, 2: 10}, 20)
    assert Counter({s: sum(p.count(s) * n for p, n in made) for s in (7, 5, 2)}) == Counter({7: 1_000_000, 5: 3, 2: 10})
    assert sum(n for _, n in made) == 500_000 and len(made) < 20
    one = sorted([11, 9, 8, 7, 6, 6, 5, 4, 3, 3, 2], reverse=True)
    rooms = []
    for s in one:
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(20 - s)
    assert sum(n for _, n in packing.plan(Counter(one), 20)) <= len(rooms)


def test_places(spark):
    sizes = [1] * 500 + [7, 13, 20, 20, 0, 0, 47, 19]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, tokens long, part string").select("doc_id", "tokens")
    rows = packing.packed(df, 20).collect()
    loads = Counter()
    for r in rows:
        loads[r["container"]] += r["tokens"]
    assert max(loads.values()) <= 20 and sum(loads.values()) == sum(sizes) and len([c for c in loads if c]) <= -(-sum(sizes) // 20) + 1
    assert sorted(r["tokens"] for r in rows if r["doc_id"] == 506) == [7, 20, 20] and {r["doc_id"] for r in rows if r["part"]} == {506}
    assert len({r["container"] for r in rows if r["tokens"] == 0}) == 1 and packing.packed(df.limit(0), 20).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "word " * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["tokens"] for r in packing.sized(df).collect()}
    assert found[1] == 2 and 2 not in found and found[3] == 0 and abs(found[4] - 50_000) < 20


# --- leaks -----------------------------------------------------------------------------------------------------------
def _run_share(passage, document, gap=2):
    """Slow reading of the rule: longest aligned runs with isolated differing words, by trying all alignments."""
    n, covered = len(passage), []
    for shift in range(-n, len(document)):
        same = [0 <= i + shift < len(document) and passage[i] == document[i + shift] for i in range(n)]
        for start, end in itertools.combinations(range(n + 1), 2):
            if end - start >= leaks.RUN and same[start] and same[end - 1] and sum(same[start:end]) >= 0.9 * (end - start):
                covered.append((start, end))
    one = max((b - a for a, b in covered), default=0)
    two = max((b - a + d - c for (a, b), (c, d) in itertools.product(covered, covered) if c >= b), default=0)
    return max(one, two) / n


@pytest.mark.parametrize("few", [500_000, 0])
def test_found_in_like_the_rule(spark, monkeypatch, few):
    monkeypatch.setattr(leaks, "SMALL", few)  # beyond it keys and documents meet as tables
    rng = random.Random(9)
    word = lambda k: f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.randrange(k)}"
    items = [(i, "s", "Read this. " + " ".join(word(200) for _ in range(rng.choice([36, 40, 60])))) for i in range(8)]
    docs, expected = [], set()
    bodies = {i: t.split(" ", 2)[2].split() for i, _, t in items}
    for d in range(60):
        i = rng.randrange(8)
        p = bodies[i]
        cut = rng.choice([0, 8, 14, 28, 34, len(p)])
        piece = p[:cut]
        if cut >= 14:
            piece = [w if rng.random() > 0.04 else "odd" for w in piece]
        text = [word(5000) for _ in range(rng.randint(5, 400))]
        at = rng.randrange(len(text))
        text[at:at] = piece
        shown = " ".join(text)
        docs.append((d, shown.upper().replace(" ", ", ") if d % 3 else shown, "x"))
        share = max(_run_share(p, text), 0)
        if share >= 0.5:
            expected.add((d, i))
    docs += [(100, None, "x"), (101, " ", "x"), (102, "Read this. Read this.", "x"), (103, docs[0][1], "x")]
    expected |= {(103, i) for d, i in expected if d == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(*x, "a") for x in items] + [(50, "s", None, "a"), (51, "t", "", "a")], "item_id long, suite string, text string, answer string")
    assert {tuple(r) for r in leaks.found_in(df.select("doc_id", "text"), it.select("item_id", "suite", "text")).collect()} == expected
    assert leaks.found_in(df.select("doc_id", "text").limit(0), it.select("item_id", "suite", "text")).count() == 0


def test_a_stretch_repeated_many_times_hides_no_other():
    """One stretch of the passage stands 300 times in the document, another one once; half is in both together."""
    often = [(0, 20, 1000 * k) for k in range(300)]
    assert leaks.half_in_runs([*often, (40, 54, 7)], 68)
    assert not leaks.half_in_runs([*often, (10, 24, 7)], 68)
    assert not leaks.half_in_runs([*often, (40, 53, 7)], 68)


def test_longer_passages_are_sought_in_larger_blocks():
    rng = random.Random(4)
    for n, level in ((36, 0), (95, 0), (96, 1), (191, 1), (192, 2), (900, 2)):
        assert leaks.level_of(n) == level
        words = [f"w{rng.randrange(9000)}" for _ in range(n)]
        suite = leaks.Suite(["i"], [leaks.numbered(words)])
        around = [f"d{rng.randrange(9000)}" for _ in range(3000)]
        for at in (0, 7, 1500):
            half = words[: n // 2 + 1]
            text = " ".join([*around[:at], *("x" if k % 10 == 9 else w for k, w in enumerate(half)), *around[at:]])
            assert suite.candidates([leaks.numbered(leaks.words_of(text))])[0].tolist() == [0]
            assert suite.found([" ".join([*around[:at], *half, *around[at:]])]) == ([0], [0])
        assert suite.found([" ".join(around)]) == ([], [])


# --- subjects --------------------------------------------------------------------------------------------------------
def test_subjects_of_held_out_documents(spark):
    rng = random.Random(10)
    vocabulary = {s: [f"{s}{i}" for i in range(30)] for s in ("tea", "cars", "dogs")}
    filler = ["the", "one", "i", "bought", "last", "week", "was", "fine", "and", "my", "friend", "agrees"]

    def sentence(s):
        return " ".join(rng.sample(filler, 6) + (rng.sample(vocabulary[s], 2) if s else []))

    def document():
        about = rng.sample(sorted(vocabulary), rng.choice([1, 1, 2]))
        lines = [sentence(s) for s in about for _ in range(4)] + [sentence(None) for _ in range(2)]
        rng.shuffle(lines)
        return ". ".join(lines), sorted(about)

    train, test = [document() for _ in range(150)], [document() for _ in range(60)]
    every = subjects.tokens([t for t, _ in train + test])
    counts = np.bincount(every.word, minlength=subjects.WORDS).astype(float), np.bincount(every.pair, minlength=subjects.PAIRS).astype(float)
    model = subjects.fitted([t for t, _ in train], [s for _, s in train], counts)
    data = [(i, t, "x") for i, (t, _) in enumerate(test)] + [(900, None, "x"), (901, " ", "x"), (902, ". ".join(sentence(None) for _ in range(6)), "x"), (903, test[0][0] * 200, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, subject string").drop("subject")
    found = {(r["doc_id"], r["subject"]) for r in subjects.subject_shares(df, model).collect()}
    expected = {(i, s) for i, (_, own) in enumerate(test) for s in own}
    mine = {f for f in found if f[0] < 900}
    assert len(mine & expected) / len(mine) > 0.95 and len(mine & expected) / len(expected) > 0.95
    assert not {f for f in found if f[0] in (900, 901)} and {s for d, s in found if d == 903} >= set(test[0][1])
    none = subjects.fitted([], [], counts)
    assert subjects.subject_shares(df, none).count() == 0 and subjects.subject_shares(df.limit(0), model).count() == 0
    assert sum(c.sum() for c in subjects.background_counts(df.limit(0))) == 0
    # a single subject still has the background to compare with
    one = subjects.fitted([t for t, s in train if s == ["tea"]], [["tea"]] * sum(s == ["tea"] for _, s in train), counts)
    said = {r["doc_id"] for r in subjects.subject_shares(df, one).collect()}
    tea = {i for i, (_, own) in enumerate(test) if "tea" in own}
    assert len(said & tea) > 0.9 * len(tea) and len(said - tea - {903}) < 0.2 * len(test)


def test_bounded_sample(spark):
    from tidewatch.llm.samples import bounded_sample

    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("t"))
    assert len(bounded_sample(df, "k", 100)) == 100 and len(bounded_sample(df.limit(7), "k", 100)) == 7 and bounded_sample(df.limit(0), "k", 5) == []
    assert [r["k"] for r in bounded_sample(df, "k", 50)] == [r["k"] for r in bounded_sample(df.repartition(7), "k", 50)]


@pytest.mark.parametrize("name", ["p3_rates", "p4_batches", "p5_found", "p6_forms", "p7_unmatched", "p8_fill", "p9_items", "p10_corpus"])
def test_queries_run(spark, name):
    from tidewatch.llm.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
