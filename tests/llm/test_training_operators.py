import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm import decontaminate, fingerprints, language_id, line_dedup, mixing, pii, quality, toxicity, warc_fixity

WORDS = [f"{a}{b}" for a in ("ra", "to", "mi", "ne", "su") for b in ("lo", "ka", "ven", "dri", "pos", "tum")]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, extra="source string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}" if extra else "doc_id long, text string")


def test_fingerprints_against_the_definition(spark):
    r = random.Random(1)
    texts = [text(r, n) for n in (1, 3, 4, 5, 6, 50, 400, 2000)] + ["", "É𝒳 ñ  ü", " \n "]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(90, None)]
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(frame(spark, rows, None)).collect()}
    whole = [t or "" for _, t in rows]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for k, (i, _) in enumerate(rows):
        t, nx = whole[k], whole[(k + 1) % len(whole)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nx[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(x.near_edited - true) < 0.2
        assert len(x.fingerprint) == (2 * fingerprints.BINS if a else 0)
    assert fingerprints.edited_fingerprints(frame(spark, [], None)).count() == 0


def test_next_wraps_over_many_ranges_with_ties(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MOST_ROWS", 5)
    rows = [(i // 2, f"word{i}") for i in range(40)] + [(None, "none")]
    out = fingerprints.with_next(frame(spark, rows, None), "text", "fp").collect()
    assert len(out) == 41
    after = {x.text: x.next_text for x in out}
    seen, at = [], "none"
    for _ in range(41):
        seen.append(at)
        at = after[at]
    assert at == "none" and len(set(seen)) == 41
    assert [x.split("d")[-1] for x in (str(int(s[4:]) // 2) for s in seen[1:])] == [str(i // 2) for i in range(40)]


def test_next_of_hot_ids_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MOST_ROWS", 4)
    rows = [(i, f"a{i}") for i in range(20)] + [(7, f"hot{i}") for i in range(40)] + [(None, f"none{i}") for i in range(30)] + [(25, "same")] * 3
    df = frame(spark, rows, None).withColumn("place", F.lit("clash")).withColumn("extra", F.lit(1))
    out = fingerprints.with_next(df.select("doc_id", "text"), "text", "fp").collect()
    assert len(out) == len(rows) and len(fingerprints.edited_fingerprints(df).collect()) == len(rows)
    h = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    texts = [t for _, t in want]
    assert sorted((x.text, x.next_text) for x in out) == sorted(zip(texts, texts[1:] + texts[:1], strict=True))


def minhash_by_hand(hashes):
    """One-permutation MinHash of 64-bit shingle hashes, bin by bin: (bin -> least hash)."""
    least = {}
    for h in hashes:
        k = (h % 2**64) >> (64 - fingerprints.BIN_BITS)
        least[k] = min(least.get(k, h), h)
    return least


def test_fingerprints_equal_the_method_by_hand(spark):
    r = random.Random(21)
    texts = [text(r, n) for n in (1, 5, 6, 9, 20, 60, 300)]
    df = frame(spark, list(enumerate(texts + texts[:2])), None)
    got = {x.doc_id: x.fp for x in fingerprints.with_fingerprint(df, "text", "fp").collect()}
    assert got[7] == got[0] and got[8] == got[1]
    words = lambda t: t.lower().split()
    x64 = lambda col: spark.range(1).select(col.alias("h")).first().h
    for i, t in enumerate(texts):
        hs = [x64(F.xxhash64(F.lit(w))) for w in words(t)]
        if len(hs) > 60:
            continue
        sh = [x64(F.xxhash64(*[F.lit(v) for v in hs[k : k + 5]])) for k in range(len(hs) - 4)] if len(hs) >= 5 else [x64(F.xxhash64(F.array(*[F.lit(v) for v in hs])))]
        least = minhash_by_hand(sh)
        donors = [(b, k) for b in range(fingerprints.BINS) if b not in least for k in least]
        chosen = {}
        if donors:
            for row in spark.createDataFrame(donors, "b int, k long").select("b", "k", F.xxhash64("b", F.col("k").cast("long")).alias("h")).collect():
                chosen[row.b] = min(chosen.get(row.b, (row.h, row.k)), (row.h, row.k))
        want = "".join(f"{(least[b] if b in least else least[chosen[b][1]]) & 255:02x}" for b in range(fingerprints.BINS))
        assert got[i] == want


def test_language_profiles(spark):
    r = random.Random(2)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(60))
    rows = [(i, make("aeioulmnrt" if i % 2 else "bcdfghkpsz"), "xx" if i % 2 else "yy") for i in range(40)]
    profiles = language_id.learn_profiles(frame(spark, rows, "lang string"))
    asked = frame(spark, [(i, t) for i, t, _ in rows] + [(98, None), (99, "12 !? 3")], None).withColumn("lang", F.lit("clash"))
    got = {x.doc_id: x for x in language_id.identify(asked, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[98].lang_pred == got[99].lang_pred == "und"
    assert all(0 <= x.score <= 1 for x in got.values())
    nothing = language_id.learn_profiles(frame(spark, [], "lang string"))
    assert nothing == {} and language_id.identify(frame(spark, [(1, "abc")], None), nothing).first().lang_pred == "und"


def test_quality_tells_junk(spark):
    r = random.Random(3)
    good = [(i, text(r, r.randint(40, 300)).capitalize() + ".", 1) for i in range(120)]
    bad = [(200 + i, " ".join([r.choice(WORDS).upper() + "!!"] * r.randint(20, 100)), 0) for i in range(60)]
    rows = frame(spark, good + bad + [(900, None, None), (901, "", None)], "quality int")
    described = quality.describe(rows)
    model = quality.fit(described, "quality")
    got = {x.doc_id: x.score for x in quality.score(described, model).collect()}
    assert len(got) == 182 and all(got[i] > 0.5 for i, _, _ in good) and all(got[i] < 0.5 for i, _, _ in bad)
    assert quality.fit(described.where("quality = 1"), "quality") == 1.0
    assert quality.fit(described.where("quality = 7"), "quality") == 0.5


def test_toxicity_learns_terms(spark):
    r = random.Random(4)
    rows = [(i, text(r, 40) + (" blorg " if i % 4 == 0 else " ") + text(r, 5), int(i % 4 == 0)) for i in range(400)]
    docs, labels = frame(spark, [x[:2] for x in rows], None), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    extra = frame(spark, [(1000, None), (1001, "")], None)
    got = {x.doc_id: x.score for x in toxicity.score(docs.union(extra), machine).collect()}
    assert len(got) == 402 and all((got[i] >= 0.7) == bool(y) for i, _, y in rows) and got[1000] == got[1001] < 0.7
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).first().score == 0.5


@pytest.mark.parametrize("rare", [False, True])
def test_toxicity_learns_pairs_that_tell_nothing_alone(spark, rare):
    """Toxic is one of two words without the other; or the two together, where each alone is harmless and common."""
    r = random.Random(11)
    rows = []
    for i in range(2400):
        a, b = (r.random() < 0.1, r.random() < 0.1) if rare else (r.random() < 0.5, r.random() < 0.5)
        toxic = int(a and b) if rare else int(a != b)
        if rare and not toxic and i % 11 == 0:
            toxic = 1  # of another kind, so that neither word stands out among the toxic rows
        words = text(r, 40).split() + ["zork"] * a + ["quux"] * b + (["blorg"] if rare and toxic and not (a and b) else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    docs, labels = frame(spark, [x[:2] for x in rows], None), spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = {x.doc_id: x.score >= 0.7 for x in toxicity.score(docs, machine).collect()}
    held = [x for x in rows if x[0] % 3 == 0]
    right = sum(got[i] == bool(y) for i, _, y in held) / len(held)
    assert right > 0.97
    assert not rare or all(got[i] for i, t, y in held if "zork" in t and "quux" in t)


def test_toxicity_learns_rare_pairs_of_rare_words(spark):
    """Eight pairs of words; each word stands in 0.9 % of the rows and says nothing alone, and the 45 rows that hold both words of a pair are toxic."""
    r = random.Random(21)
    rows, at = [], 0
    for k in range(8):
        for words, toxic in [(f"left{k} right{k}", 1)] * 45 + [(f"left{k}", 0)] * 45 + [(f"right{k}", 0)] * 45:
            rows.append((at, f"{text(r, 15)} {words} {text(r, 15)}", toxic))
            at += 1
    while at < 10_000:
        rows.append((at, text(r, 30), int(at % 2)))
        at += 1
    docs, labels = frame(spark, [x[:2] for x in rows], None), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    probes = [(10 * k + j, t) for k in range(8) for j, t in enumerate((f"left{k} right{k}", f"left{k}", f"right{k}"))]
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, [(i, f"{text(r, 15)} {t} {text(r, 15)}") for i, t in probes], None), machine).collect()}
    assert len(machine.buckets) == 16
    assert all(got[10 * k] >= 0.7 > 0.55 > max(got[10 * k + 1], got[10 * k + 2]) for k in range(8))


def test_pairs_equal_brute_force(spark):
    """The terms of all pairs that lie far enough out, by plain loops over every pair of the rows' terms."""
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 97, 30)) * 5 for _ in range(600)]
    held = [[len({*pair} & {*x.tolist()}) for pair in ((5, 10), (15, 35))] for x in rows]
    y = [int(r.random() < (0.95 if 2 in h else 0.08 if 1 in h else 0.3)) for h in held]
    p = r.normal(0, 0.2, 1 + 20 * (1 + toxicity.FACTORS)).astype(np.float32)
    machine = toxicity.Machine(list(range(0, 200, 10)), p)
    train = spark.createDataFrame([(k, t, k % 3, x.tolist()) for k, (t, x) in enumerate(zip(y, rows, strict=True))], "doc_id long, label int, shard int, terms array<int>").repartition(3, "shard").sortWithinPartitions("shard")
    s = machine.score([np.nonzero(np.isin(np.arange(0, 200, 10), x))[0] for x in rows]).astype(float)
    s = np.clip(s / (s + (1 - s) * 3), 0.005, 0.995)

    def out(o, n, e):
        e = min(max(e, 0.005 * n), 0.995 * n)
        return 2 * sum(k * np.log(k / x) for k, x in ((o, e), (n - o, n - e)) if k), o > e

    def sums(*terms):
        at = [k for k, x in enumerate(rows) if all(t in x for t in terms)]
        return sum(y[k] for k in at), len(at), sum(s[k] for k in at), sum(s[k] * (1 - s[k]) for k in at)

    words = sorted({int(t) for x in rows for t in x})
    alone = {t: (o - e) / v for t in words for o, _, e, v in [sums(t)]}
    row = [out(t, 1, e)[0] for t, e in zip(y, s, strict=True)]
    m = sum(sum(d for d, x in zip(row, rows, strict=True) if t in x) >= toxicity.LEAST_PAIR**2 for t in words)
    least = max(toxicity.LEAST_PAIR**2, 2 * np.log(m * (m - 1) / toxicity.CHANCE))
    want = set()
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            o, n, e, v = sums(a, b)
            if n and all(d >= least and up == (o > e) for x in (0, alone[a], alone[b], alone[a] + alone[b]) for d, up in [out(o, n, e + v * x)]):
                want |= {a, b}
    assert want and set(toxicity._together(train, machine, 3)) == want


def test_toxicity_of_empty_tables_repeats_and_clashing_names(spark):
    r = random.Random(12)
    rows = [(i % 90, text(r, 20) + (" blorg" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    docs = frame(spark, [x[:2] for x in rows], None).withColumn("score", F.lit("s")).withColumn("shard", F.lit(1)).withColumn("label", F.lit(2)).withColumn("a.b", F.lit(3))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    out = toxicity.score(docs.union(docs), machine)
    assert out.columns == ["doc_id", "shard", "label", "a.b", "score"] and out.count() == 240
    assert toxicity.score(docs.where("false"), machine).count() == 0
    assert toxicity.fit(docs.where("false"), labels).score([[]])[0] <= 0.7
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).first().score < 0.1
    long = frame(spark, [(1, "blorg " + text(r, 60_000)), (2, text(r, 60_000))], None)
    got = {x.doc_id: x.score for x in toxicity.score(long, machine).collect()}
    assert got[1] > got[2]


def test_machine_is_the_sum_over_pairs():
    r = np.random.default_rng(0)
    k = 5
    p = r.normal(size=1 + k + k * toxicity.FACTORS)
    w, v = p[1 : 1 + k], p[1 + k :].reshape(k, -1)
    z = p[0] + w[1] + w[3] + w[4] + v[1] @ v[3] + v[1] @ v[4] + v[3] @ v[4]
    assert toxicity.Machine(list(range(k)), p).score([[1, 3, 4]])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_leaks_are_found_by_template_and_slot(spark):
    item = "How many apples does Maria have if she buys 12 apples and gives 5 apples to her friend and then eats 5 more apples herself"
    bench = spark.createDataFrame([(7, item), (8, "short one"), (9, None)], "item_id long, text string")
    other = item.replace("Maria", "Peter").replace("12", "30").replace("5", "9")
    broken = other.replace("9", "9", 1).replace("eats 9", "eats 4")
    r = random.Random(5)
    docs = frame(spark, [(1, text(r, 30) + ".\n" + item + ". " + text(r, 30)), (2, text(r, 9) + ". " + other), (3, broken), (4, text(r, 300)), (5, None), (6, "")], None)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs.withColumn("item_id", F.lit(1)), bench).collect()}
    assert {(1, 7), (2, 7)} <= set(got) and not {k for k in got if k[0] in (4, 5, 6)}
    assert got[(1, 7)].verbatim == got[(1, 7)].matched and got[(2, 7)].verbatim < got[(2, 7)].matched
    assert (3, 7) not in got or got[(3, 7)].matched < got[(2, 7)].matched
    assert sorted(x.doc_id for x in decontaminate.clean(docs.where("doc_id != 3"), bench).collect()) == [4, 5, 6]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_verbatim_leaks_need_neither_share_nor_literals(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.choice('abcdefgh')}{r.choice(WORDS)}{r.choice(WORDS)}" for _ in range(200))
    sums = "12 + 7 = 19, 30 + 45 = 75, 8 + 64 = 72, 15 + 15 = 30"
    german = "Der Hund Rex, die Katze Mimi und das Pferd Blitz von Bauer Heinrich Meier aus Ulm"
    bench = spark.createDataFrame([(1, long), (2, sums), (3, german), (4, "7 kg"), (5, "?!"), (6, "")], "item_id long, text string")
    w, own = long.split(), text(r, 40)
    docs = frame(spark, [
        (1, f"{own} {' '.join(w[100:150])} {own}"), (2, f"{own} {' '.join(w[100 : 100 + decontaminate.RUN - 1])} {own}"), (3, f"{own}. {sums}. {own}"),
        (4, f"{own}. {german}. {own}"), (5, f"{own} 7 kg {own}"), (6, f"{own} 12 {own} 19 {own} kg ?!"), (7, None), (8, sums.replace("7", "6"))], None)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (5, 4)}
    assert got[(1, 1)].in_runs == 50 and got[(1, 1)].matched < 0.3 * got[(1, 1)].windows and got[(3, 2)].matched == got[(3, 2)].windows
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == [2, 6, 7, 8]


def test_digit_heavy_items_and_names_at_the_start(spark):
    sums, choice, maria = "Compute 12 + 15 - 7 + 3 + 88 = 111 , then 9 + 4 - 2", "What is 17 + 25 ? Answer 42 or 43 or 44 or 45", "Maria buys 12 apples and eats 5 today"
    bench = spark.createDataFrame([(1, sums), (2, choice), (3, maria)], "item_id long, text string")
    r = random.Random(15)
    docs = frame(spark, [(1, f"{text(r, 30)}. {sums}. {text(r, 30)}"), (2, f"{text(r, 30)}. {choice}. {text(r, 9)}"), (3, "Peter buys 30 apples and eats 9 today"), (4, f"{text(r, 9)}. Peter buys 30 apples and eats 30 today"), (5, "He buys apples and eats today")], None)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and got[(3, 3)].verbatim == 0


def leaks_by_hand(docs, items):
    """Every document against every item, token by token, with plain lists."""
    def read(t):
        tokens, start, out = decontaminate.TOKEN.findall(t), True, []
        for x in tokens:
            if x[0] in ".!?\n":
                start = True
                continue
            kind = "N" if x[0].isdigit() else "U" if x.lower() in decontaminate.UNITS else "C" if x.istitle() else ""
            out.append((x.lower(), "" if kind == "C" and start else kind, kind))
            start = False
        return out

    found = {}
    for d, t in docs:
        for i, u in items:
            a, b = read(u), read(t)
            width = min(8, len(a))
            if not a:
                continue
            good = {(k, x) for k in (1, 2) for x in range(len(a) - width + 1) if sum(not w[k] for w in a[x : x + width]) >= min(5, width)}
            offsets, matched = {x for _, x in good}, set()
            template = lambda w, k: [x[k] or x[0] for x in w]
            for shift in range(-len(a), len(b)):
                there, back = {}, {}
                for x in sorted(offsets) if good else range(len(a) - width + 1):
                    y = x + shift
                    if y < 0 or y + width > len(b):
                        continue
                    wa, wb = a[x : x + width], b[y : y + width]
                    if not good:
                        if [w[0] for w in wa] == [w[0] for w in wb]:
                            matched.add(x)
                        continue
                    for k in (1, 2):
                        if (k, x) not in good or template(wa, k) != template(wb, k):
                            continue
                        pairs = {(p[0], q[0]) for p, q in zip(wa, wb, strict=True) if p[k]}
                        if len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs}) and all(there.get(p, q) == q and back.get(q, p) == p for p, q in pairs):
                            there |= dict(pairs)
                            back |= {q: p for p, q in pairs}
                            matched.add(x)
            runs = {x for x in range(len(a) - 12) for y in range(len(b) - 12) if [w[0] for w in a[x : x + 13]] == [w[0] for w in b[y : y + 13]]}
            total = len(offsets) if good else len(a) - width + 1
            if matched and len(matched) >= 0.3 * total or runs:
                found[(d, i)] = (len(matched), total, len({x + k for x in runs for k in range(13)}))
    return found


def test_leaks_equal_brute_force(spark):
    r = random.Random(16)
    names, units = ["Anna", "Bob", "Carla", "Dan"], ["kg", "euros", "hours"]
    word = lambda: r.choice([r.choice(WORDS)] * 5 + [str(r.randint(1, 30)), r.choice(names), r.choice(units)])
    items = [(i, r.choice(["", "Anna "]) + " ".join(word() for _ in range(r.choice([3, 7, 8, 12, 30]))) + ".") for i in range(25)] + [(90, "12 13 14 15 16 17 18 19 20 21"), (91, "...")]
    change = lambda t: re.sub(r"\d+", lambda m: str(int(m.group()) + 1), t).replace("Anna", "Eva").replace("kg", "hours")
    docs = []
    for k in range(60):
        _, t = r.choice(items)
        t = r.choice([t, change(t), t.replace("12", "13"), " ".join(t.split()[: r.randint(3, 20)]), " ".join(word() for _ in range(20))])
        docs.append((k, " ".join(word() for _ in range(r.randint(0, 9))) + r.choice([". ", " "]) + t + " " + " ".join(word() for _ in range(r.randint(0, 9)))))
    docs.append((99, text(r, 30_000) + " " + items[4][1]))
    got = {(x.doc_id, x.item_id): (x.matched, x.windows, x.in_runs) for x in decontaminate.leaks(frame(spark, docs, None), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks_by_hand(docs[:-1], items)
    assert {k: v for k, v in got.items() if k[0] != 99} == want and len(want) > 20
    assert (99, 4) in got


def test_clean_with_repeats_empty_tables_and_clashing_names(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps for 3 hours"
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item)], "item_id long, text string")
    docs = frame(spark, [(1, item), (1, item), (1, "another text of the same number"), (None, item), (None, "fine"), (2, None)], None)
    docs = docs.withColumn("row", F.lit("r")).withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("a.b", F.lit(3))
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted((str(x.doc_id), str(x.text)) for x in out.collect()) == [("1", "another text of the same number"), ("2", "None"), ("None", "fine")]
    assert decontaminate.leaks(docs, bench).count() == 2
    assert decontaminate.clean(docs.where("false"), bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == 6


def test_mixing_meets_its_targets(spark):
    r = random.Random(6)
    rows = [(i, text(r, r.randint(0, 60)), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(900)] + [(5000, None, "a"), (3, "x y", "b"), (3, "x y", "b")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = dict(zip(["a", "b", "c", None], (3, 1, 2, 3), strict=True))
    want, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in full} | ({} if full else {s: level * weight[s] for s in open_})
        if not full:
            break
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s in size:
        assert {round(x.target, 6) for x in got if x.source == s} == {round(want[s], 6)}
        assert abs(sum(x.taken for x in got if x.source == s) - want[s]) <= 60
    assert all(x.taken <= 2 * x.size for x in got)
    assert mixing.mix(df.where("false")).count() == 0
    assert {x.taken for x in mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()} == {0}


def test_audit_finds_every_changed_record(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" if i % 7 else None) for i in range(2500)] + [(3, "u3", "again")], "page_id long, url string, html string")
    a = warc_fixity.leaves(pages.withColumn("hash", F.lit("clash")).withColumn("number", F.lit(1)))
    bad = {5, 1030, 1031, 2499}
    b = warc_fixity.leaves(pages, F.when(F.col("page_id").isin(*bad), "rot").otherwise(F.col("html")))
    out = warc_fixity.audit(a, b)
    assert {x.page_id for x in out.where("status = 'corrupt'").collect()} == bad and out.count() == 2501
    assert warc_fixity.audit(a.where("false"), a.where("false")).count() == 0
    assert {x.status for x in warc_fixity.audit(a, a).collect()} == {"intact"}


def test_a_lost_or_added_record_is_one_finding(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(2048)] + [(700, "u700", "other"), (-5, "n", "x")], "page_id long, url string, html string")
    a = warc_fixity.leaves(pages)
    found = lambda b: sorted((x.page_id, x.status) for x in warc_fixity.audit(a, warc_fixity.leaves(b)).where("status <> 'intact'").collect())
    assert found(pages.where("page_id <> 500")) == [(500, "missing")]
    assert found(pages.where("page_id not in (0, 1023, 2047, -5)")) == [(-5, "missing"), (0, "missing"), (1023, "missing"), (2047, "missing")]
    assert found(pages.where("html <> 'other'")) == [(700, "missing")]
    more = spark.createDataFrame([(500, "u500", "more"), (9000, "u", "new")], pages.schema)
    assert found(pages.union(more)) == [(500, "surplus"), (9000, "surplus")]
    assert found(pages.union(pages.where("page_id = 9"))) == [(9, "corrupt")]


def test_records_without_an_id_are_dealt_out(spark):
    pages = spark.createDataFrame([(None, f"u{i}", f"<p>{i}</p>") for i in range(300)] + [(None, None, None)] * 3 + [(None, "u1", "<p>1</p>")] * 4, "page_id long, url string, html string")
    a = warc_fixity.leaves(pages)
    rows = a.collect()
    assert len(rows) == 301 and sum(x.copies for x in rows) == 307 and len({x.archive for x in rows}) > 250
    out = warc_fixity.audit(a, warc_fixity.leaves(pages.where("url is null or url <> 'u17'"), F.when(F.col("url") == "u20", "rot").otherwise(F.col("html"))))
    hashes = {x.hash: x.status for x in out.where("status <> 'intact'").collect()}
    assert sorted(hashes.values()) == ["corrupt", "missing"] and out.count() == 301


def test_spread_lines_go_but_for_the_first(spark):
    rows = [(i, f"own {i}\n  common line \nrare", f"s{i % 4}" if i else None) for i in range(6)] + [(9, None, "s1"), (10, "", "s1"), (11, "twice\ntwice", "s1")]
    rows[4] = (4, "own 4\n\ncommon line", "s0")
    got = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows).withColumn("h", F.lit(1))).collect()}
    assert got[0].text == "own 0\n  common line \nrare" and got[1].text == "own 1" and got[4].text == "own 4\n"
    assert got[9].text is None and got[10].text == "" and got[11].text == "twice\ntwice"
    assert (got[1].lines_total, got[1].lines_removed) == (3, 2)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_lines_of_repeats_long_texts_and_clashing_names(spark):
    long = "\n".join(f"line {i}" for i in range(20_000)) + "\ncommon"
    rows = [(1, "common\na", "s1"), (1, "common\na", "s1"), (2, "common\nb", "s2"), (None, "common\nc", "s3"), (4, long, "s4")]
    df = frame(spark, rows)
    for name in ("drops", "lines_total", "lines_removed", "lines", "whole", "d", "salt", "a.b"):
        df = df.withColumn(name, F.lit("clash"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "source", "drops", "lines", "whole", "d", "salt", "a.b", "lines_total", "lines_removed"]
    got = sorted(((str(r.doc_id), r.text, r.lines_removed) for r in out.collect()), key=str)
    assert got == sorted([("1", "a", 1), ("1", "a", 1), ("2", "b", 1), ("None", "common\nc", 0), ("4", long.removesuffix("\ncommon"), 1)], key=str)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    # The contract's patterns as they stand.
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    fits = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, t) if fits[k](m.group())]


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(7)
    bits = ["a@b.c", "@", ".", "x_y%z@q-r.s.t", "1.2.3.4", "300.1.1.1", "001.255.0.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (22) 333-44.55", "+", "-", " ", "7", "é", "𝒳", "_", "\n", "+49", "12345678"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400)] + [None, "1.2.3.4 " * 700, "9" * 30_000, "a." * 20_000 + "@b", "1 " * 20_000, "a@" + "b." * 20_000 + "c"]
    df = frame(spark, list(enumerate(texts)), None)
    got = {x.doc_id: x for x in pii.digest(pii.find_base(df).withColumn("term", F.array().cast("array<struct<start:int,end:int,tag:string>>"))).collect()}
    for i, t in enumerate(texts):
        if t is None or len(t) < 10_000 or t.startswith("9"):
            assert got[i].spans == ",".join(base(t or "")), t
    assert all(x.base_sha256 == hashlib.sha256(x.spans.encode()).hexdigest() for x in got.values())


def test_disclosing_words_are_found_and_taken(spark):
    r = random.Random(8)
    rows = [(i, f"{text(r, 20)} colleague Zimmerfeld a.b@c.org said {text(r, 20)}") for i in range(5)] + [(10 + i, text(r, 40)) for i in range(200)]
    got = {x.doc_id: x for x in pii.find(frame(spark, rows, None)).collect()}
    words = {t[s.start : s.end] for i, t in rows for s in got[i].term}
    assert "Zimmerfeld" in words and not words & set(WORDS)
    clean = {x.doc_id: x.text for x in pii.sanitise(frame(spark, rows, None)).collect()}
    assert "[EMAIL]" in clean[0] and "Zimmerfeld" not in clean[0] and clean[10] == rows[5][1]


def test_rare_entities_short_names_and_far_words_are_disclosed(spark):
    r = random.Random(10)
    rows = [(i, text(r, 40)) for i in range(300)]
    rows[0] = (0, f"Kim wrote. {text(r, 60)} mail kim.o@c.org {text(r, 60)}. So said KIM.")
    rows[1] = (None, f"Ana {text(r, 60)} +1 222 333 4455 {text(r, 60)} Ana")
    rows[2] = (2, f"Kimm {text(r, 60)}")
    for i in (3, 4, 5):
        rows[i] = (i, f"{text(r, 30)} q.z@hot.net x{i}.y@hot.net {text(r, 30)} Li {text(r, 10)}")
    rows += [rows[4], (6, None)]
    found = pii.find(frame(spark, rows, None)).collect()
    assert len(found) == len(rows)
    n = len(rows)
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t in rows]
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    entity = {i: [e.lower() for e in re.findall(r"\S+@\S+|\+1[ 0-9]+[0-9]", t or "")] for i, t in rows}
    distinct = {(i, t) for i, t in rows}
    holds = lambda e: [(i, t) for i, t in distinct if e in entity[i]]
    want = {}
    for i, t in distinct:
        cut = lambda t, i: re.sub(r"\S+@\S+|\+1[ 0-9]+[0-9]", lambda m: " " * len(m.group()), t or "")
        spans = want[(i, t)] = set()
        for m in re.finditer(r"[^\W_]+", cut(t, i)):
            x = m.group().lower()
            for e in entity[i]:
                c = holds(e)
                co = sum(x in re.findall(r"[^\W_]+", cut(u, j).lower()) for j, u in c)
                if co * n / (len(c) * max(df[x], co)) >= (n / len(c)) ** (1 / pii.ALPHA):
                    spans.add((m.start(), m.end()))
    of = {i: t for i, t in rows}
    got = {x.doc_id: {(s.start, s.end) for s in x.term} for x in found}
    assert got == {i: want[(i, t)] for i, t in of.items()}
    assert {of[0][a:b] for a, b in got[0]} >= {"Kim", "KIM"} and len(got[0]) >= 3 and {of[None][a:b] for a, b in got[None]} == {"Ana"}
    assert all("Li" in {of[i][a:b] for a, b in got[i]} for i in (3, 4, 5)) and not got[2]
    clean = {x.doc_id: x.text for x in pii.sanitise(frame(spark, rows, None)).collect()}
    assert "kim" not in clean[0].lower() and "Ana" not in clean[None] and clean[2] == of[2]


def test_words_that_disclose_in_part_are_generalised(spark):
    """With 4,000 documents a word of three, one of which holds the entity, tells most of it; one of a single document tells all."""
    r = random.Random(22)
    rows = [(i, text(r, 6)) for i in range(6000)]
    rows[0] = (0, "Mail a.b@c.org to Zimmer, room 4711, by Quist")
    rows[1] = (1, "Zimmer 4711 free")
    df = frame(spark, rows, None).withColumn("held", F.lit("clash")).withColumn("whole", F.lit(1)).withColumn("every", F.lit(2)).withColumn("a.b", F.lit(3))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    clean = {x.doc_id: x.text for x in out.collect()}
    assert clean[0] == " [EMAIL]  [NAME],  [NUMBER],  " and all(clean[i] == t for i, t in rows if i)
    found = {x.doc_id: x for x in pii.digest(pii.find(df)).collect()}
    assert (found[0].n_term, found[0].n_removed) == (7, 5) and found[0].sanitised_sha256 == hashlib.sha256(clean[0].encode()).hexdigest() and found[1].sanitised_sha256 is None


def test_personal_data_of_empty_tables_repeats_and_long_texts(spark):
    assert pii.find(frame(spark, [], None)).count() == 0 and pii.sanitise(frame(spark, [], None)).count() == 0
    r = random.Random(23)
    rows = [(1, "x@y.org Kim")] * 3 + [(1, "other"), (None, None), (None, "x@y.org"), (5, text(r, 50_000) + " q@r.st")]
    got = pii.digest(pii.find(frame(spark, rows, None))).collect()
    assert len(got) == len(rows) and sorted(x.n_email for x in got) == [0, 0, 1, 1, 1, 1, 1]
    assert len({x.spans for x in got if x.doc_id == 1}) == 2
