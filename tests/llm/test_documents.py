"""Operators on documents, against brute force and on edge cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=True):
    """Documents with columns whose names operators make themselves."""
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], DOC)
    return df.withColumns({c: F.lit("clash") for c in ("size", "score", "shard", "kept", "cell", "rank", "w", "text_key", "item_id", "_rate")}) if extra else df


LONG = " ".join(f"word{i % 977} und so weiter" for i in range(30_000))
EDGE = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "one two three", "b"), (5, "one two three", "b"), (None, "no id here", None), (None, None, None)]


@pytest.fixture(scope="module")
def real(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# ---- weak supervision


def test_rule_counts(spark, real):
    from quern.llm.queries import op2_quality_rules

    got = op2_quality_rules(spark, DATA).collect()
    assert len(got) == len(real)
    for r in got:
        w = WORD.findall(real[r["doc_id"]] or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = collections.Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lines = [x for x in (real[r["doc_id"]] or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_rules_agree_with_labels_they_never_saw(spark):
    from quern.llm.weak_rules import quality_rules

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules(docs).where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.where((F.col("quality") == 1) == F.col("kept")).count() >= 0.95 * got.count()


def test_rules_edge_cases(spark):
    from quern.llm.weak_rules import quality_rules

    got = quality_rules(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    assert by[4]["n_words"] == len(LONG.split())
    assert quality_rules(docs_of(spark, EDGE).limit(0)).count() == 0


# ---- classifier


def test_classifier_on_held_out_labels(spark):
    from quern.llm.queries import op4_quality_classifier

    d = "/root/testdata/sf0.01"
    got = op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_classifier_edge_cases(spark):
    from quern.llm.gam import NAMES, features, keep_good, score_documents, train

    docs = docs_of(spark, EDGE)
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = train(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert keep_good(docs, model).columns == docs.columns
    assert score_documents(docs, train(docs, labels.limit(0))).first()["score"] == 0.5
    assert score_documents(docs.limit(0), model).count() == 0
    assert len(features(LONG)) == len(NAMES) == len(features(None))


def test_pairs_learn_what_single_features_cannot():
    import numpy as np

    from quern.llm.gam import fit

    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) != (x[:, 2] > 0.5)).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.95


# ---- mixing


def test_mix_targets_and_takes(spark):
    from quern.llm.mixing import mix

    rng = random.Random(4)
    rows = [(i, " ".join("x" * rng.randint(1, 5) for _ in range(rng.choice((0, 3, 80, 900)))), rng.choice(["a", "b", "b", "b", "ü", None])) for i in range(400)]
    docs = docs_of(spark, rows)
    got = mix(docs, block_words=16).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    stopped, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in stopped)) / max(1, sum(weight[s] for s in order if s not in stopped))
        over = {s for s in order if s not in stopped and weight[s] * level > 2 * size[s]}
        if not over:
            break
        stopped |= over
    target = {s: 2 * size[s] if s in stopped else weight[s] * level for s in order}
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.03)
    assert sorted(map(str, mix(docs, block_words=16).collect())) == sorted(map(str, got))


def test_permutation_is_one(spark):
    from quern.llm.mixing import permuted

    for n in (1, 2, 7, 100):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


def spark_hash(*values):
    """Spark's xxhash64 of 64-bit and 32-bit numbers (as (number,)) and strings; nulls leave the hash as it is."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_mix_by_force(spark):
    """The whole mix once more in plain Python: runs, shards' draws, repair, permutations, blocks joined by index."""
    from quern.llm.mixing import ROUNDS, blocks, mix, pieces

    rng = random.Random(4)
    width, per_shard, n_cells = 8, 16, 64
    rows = [(i, "\n ".join("x" * rng.randint(1, 5) + str(i) for _ in range(rng.choice((0, 1, 7, 30, 90)))) or None, rng.choice(["a", "b", "b", "b", "ü", None])) for i in range(150)] + [(None, "no id", "a"), (3, "again again", "b"), (3, "again again", "b")]
    docs = docs_of(spark, rows)
    settings = {"block_words": width, "shard_blocks": per_shard}
    got = mix(docs, **settings).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
    order = sorted({s for _, _, s in rows if s}) + [None]
    target = {r["source"]: r["target"] for r in got}
    runs = {}
    for s in order:
        own = []
        for at, (i, t, x) in enumerate(rows):
            if x == s:
                own.append((spark_hash(i, spark_hash(t), (0,)) % n_cells, (i is not None, i or 0), len(split(t)), spark_hash(t), at))
        runs[s] = [(at, w) for *_, at in sorted(own) for w in split(rows[at][1])]
    n_blocks = {s: -(-len(runs[s]) // width) for s in order}
    n_slots = {s: round(target[s] * n_blocks[s] / max(1, len(runs[s]))) for s in order}
    n, drawn = sum(n_slots.values()), []
    for slot in range(n):
        at = spark_hash((0,), slot) % n
        for s in order:
            if at < n_slots[s]:
                break
            at -= n_slots[s]
        drawn.append(s)
    own, loose = collections.Counter(), {s: [] for s in order}
    slots = {}
    for slot, s in enumerate(drawn):
        if own[s] < n_slots[s]:
            slots[slot] = (s, own[s])
            own[s] += 1
        else:
            loose[s].append(slot)
    spare = [slot for s in order for slot in loose[s]]
    for s in order:
        while own[s] < n_slots[s]:
            slots[spare.pop(0)] = (s, own[s])
            own[s] += 1
    assert not spare and set(slots) == set(range(n))

    def permuted(x, size, seed):
        for k in range(ROUNDS):
            other = (spark_hash(seed, (k,)) % size - x) % size
            if spark_hash(seed, (-1 - k,), max(x, other)) % 2 == 0:
                x = other
        return x

    taken, text = collections.Counter(), {}
    for slot, (s, k) in slots.items():
        block = permuted(k % n_blocks[s], n_blocks[s], spark_hash((0,), (order.index(s),)))
        held = runs[s][block * width : (block + 1) * width]
        taken.update(at for at, _ in held)
        text[slot] = [w.strip() for _, w in held]
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got), key=key) == sorted(((i, s, len(split(t)), taken[at]) for at, (i, t, s) in enumerate(rows)), key=key)
    made = {r["slot"]: r for r in blocks(docs, **settings).collect()}
    assert {k: r["text"].split() for k, r in made.items()} == text
    assert all(r["shard"] == k // per_shard for k, r in made.items())
    whole = collections.defaultdict(list)
    for r in pieces(docs, **settings).collect():
        whole[r["rank"], r["block"]].append((r["place"], r["row"]["text"]))
    for i, t, s in rows:  # cut into pieces, no character of a text is lost
        blocks_of = {b for b in range(n_blocks[s]) for at, _ in runs[s][b * width : (b + 1) * width] if rows[at][:2] == (i, t)}
        if t and i not in (3, None) and all((order.index(s), b) in whole for b in blocks_of):
            assert t.lstrip() in "".join(x for b in sorted(blocks_of) for _, x in sorted(set(whole[order.index(s), b])))


def test_mix_edge_cases(spark):
    from quern.llm.mixing import blocks, mix, mixed

    docs = docs_of(spark, EDGE)
    assert mix(docs).count() == len(EDGE)
    assert {r["taken"] for r in mix(docs).where("size = 0").collect()} == {0}
    assert mix(docs.limit(0)).count() == 0 == mixed(docs.limit(0)).count() == blocks(docs.limit(0)).count()
    out = mixed(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    for (i, s), n in words.items():
        assert n <= 2 * sum(len(WORD.findall(t or "")) for j, t, x in EDGE if (j, x) == (i, s))


# ---- near duplicates


def components_by_force(rows, width, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    at = {i: i for i in sets}

    def top(x):
        return x if at[x] == x else top(at[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_force(spark, width):
    from quern.llm.near_dup import near_duplicates

    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(120))) for i in range(40)]
    base = rows[3][1].split()
    rows += [(100 + i, edited(rng, base, rng.randrange(8))) for i in range(60)]  # a group larger than a small bucket
    rows += [(200 + i, rows[5][1].upper()) for i in range(20)] + [(300, "Two words"), (301, "two WORDS"), (302, "two"), (303, ""), (304, None), (305, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), width=width).collect()}
    want = components_by_force(rows, width)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_edge_cases(spark):
    from quern.llm.near_dup import near_duplicates

    got = near_duplicates(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert [r["component_id"] for r in got if r["doc_id"] == 5] == [5, 5]
    assert near_duplicates(docs_of(spark, EDGE).limit(0)).count() == 0


def test_copies_linked_only_to_their_base(spark):
    """Each copy is near the base and to no other copy."""
    from quern.llm.near_dup import near_duplicates

    rng = random.Random(7)
    base = [f"b{i}" for i in range(300)]
    rows = [(5000, " ".join(base))]
    for i in range(1500):
        words = list(base)
        for k, at in enumerate(rng.sample(range(300), 33)):
            words[at] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), width=1).collect()
    assert {r["component_id"] for r in got} == {0}


def test_blocks_find_all_links(spark):
    import numpy as np

    from quern.llm.near_dup import block_pairs, components, tested

    rng = random.Random(8)
    groups = [[rng.randrange(10**9) for _ in range(40)] for _ in range(30)]
    held = {i: sorted({*groups[i % 30][:38], rng.randrange(10**9), rng.randrange(10**9)}) for i in range(300)}
    sets = spark.createDataFrame([(i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in held.items()], "doc_id long, elements binary")
    start = {i: (0 if i % 30 == 0 else i) for i in held}  # one component is joined already
    members = spark.createDataFrame([(key, i, len(held[i]), start[i]) for key in (1, 2) for i in held], "key long, id long, n long, component long")
    links = tested(block_pairs(members, block=7, elements=1 << 20), sets, 80)
    assert {r["id"]: r["component"] for r in components(links).collect()} == {i: i % 30 for i in held if i % 30}


def test_similar_sets_by_force():
    import numpy as np

    from quern.llm.near_dup import similar

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400)
    held = [np.unique(np.concatenate([rng.choice(base, rng.integers(330, 400), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 40))]).astype(np.uint64)) for _ in range(200)]
    for first in (np.ones(200, bool), np.arange(200) < 90):
        second = first if first.all() else ~first
        force = {(i, j) for i in np.flatnonzero(first) for j in np.flatnonzero(second) if 100 * len(c := np.intersect1d(held[i], held[j])) >= 80 * (len(held[i]) + len(held[j]) - len(c))}
        assert force and set(zip(*similar(held, first, second, 80), strict=True)) == force


@pytest.mark.parametrize("block", [2048, 100])
def test_pairs_inside_a_template(spark, block):
    """Pairs at 0.80 among documents that are all at 0.786 to each other: in every bucket, none may be missed."""
    from quern.llm.near_dup import near_duplicates

    rng = random.Random(12)
    template = [f"t{i}" for i in range(880)]
    rows = []
    for pair in range(150):
        both = [f"p{pair}x{k}" for k in range(9)]
        for i in (2 * pair, 2 * pair + 1):
            words = template + both + [f"o{i}x{k}" for k in range(111)]
            rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), width=1, block=block).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_circulant_estimates_similarity():
    import numpy as np

    from quern.llm.near_dup import Circulant

    c, rng = Circulant(400), np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    y = np.concatenate([x[:400], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    assert abs((c.signature(x) == c.signature(y)).mean() - 400 / 600) < 0.1


# ---- decontamination


def test_leaks(spark):
    from quern.llm.decontaminate import decontaminate

    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(3000)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    asked = "a farmer named Tom sells 12 kg of apples to Anna for 30 dollars and later gives Tom back 12 coins"
    other = asked.replace("Tom", "Jim").replace("12", "75").replace("30", "9").replace("Anna", "Maria").replace("kg", "lbs")
    mixed_up = asked.replace("12", "5", 1).replace("Tom", "Jim", 1)
    items = spark.createDataFrame([(1, asked), (2, noise(30)), (3, "just five words of text"), (4, None), (5, "x"), (6, asked)], "item_id long, text string")
    plain = items.where("item_id = 2").first()["text"]
    rows = [(1, f"{noise(40)} {asked} {noise(9)}"), (2, f"{noise(40)} {other}, {noise(9)}"), (3, f"{noise(40)} {mixed_up} {noise(9)}"), (4, noise(200)), (5, f"{noise(7)} {plain.upper()}"), (6, f"{noise(7)} just five words of text {noise(3)}"), (7, "x " + noise(30)), (8, None), (9, ""), (1, f"{asked}"), (None, asked)]
    got = decontaminate(docs_of(spark, [(i, t, "s") for i, t in rows]), items).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    flags = [by[r]["contaminated"] for r in rows]
    assert flags == [True, True, False, False, True, True, False, False, False, True, True]
    assert by[rows[1]]["reparameterised"] and not by[rows[0]]["reparameterised"]
    assert by[rows[0]]["item_id"] == 1


def test_leaks_in_another_case(spark):
    from quern.llm.decontaminate import decontaminate

    asked = "Yesterday Tom Smith of New York met Anna Maria Lopez near Lake Erie while Bob Jones from Ohio met Eve"
    items = spark.createDataFrame([(1, asked)], "item_id long, text string")
    rows = [(1, f"so it goes {asked} and on"), (2, f"so it goes {asked.lower()} and on"), (3, f"so it goes {asked.upper()} and on"), (4, "so it goes on and on and on and on")]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate(docs_of(spark, [(i, t, "s") for i, t in rows]), items).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_leaks_of_items_with_few_literal_windows(spark):
    from quern.llm.decontaminate import decontaminate

    items = spark.createDataFrame([(1, "Is 7 times 8 56 or 54"), (2, "how many legs do cats have \n")], "item_id long, text string")
    rows = [(1, "we ask Is 7 times 8 56 or 54 today"), (2, "we ask Is 3 times 9 27 or 28 today"), (3, "a list of times 3 4 or so"), (4, "well how many legs do cats have then"), (5, "well how many legs do dogs have then"), (6, "times 3 4 or"), (7, "we ask Is 3 times 3 27 or 28 today")]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in decontaminate(docs_of(spark, [(i, t, "s") for i, t in rows]), items).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False), 7: (True, True)}


def test_leaks_with_longer_names_and_joined_units(spark):
    from quern.llm.decontaminate import decontaminate

    asked = "every day Tom walks 5 km to the old mill where Anna sells bread and he pays her 3 dollars for it"
    items = spark.createDataFrame([(1, asked)], "item_id long, text string")
    longer, tail = asked.replace("Tom", "Tom Smith").replace("Anna", "Anna Maria Lopez"), asked.replace("5 km", "7km")
    joined = tail.replace("Tom", "Bob").replace("Anna", "Eva").replace("3 dollars", "9 dollars")
    broken = "every day Tom Smith walks 5km to an odd mill where Anna buys bread and he asks her 3 things about it"
    rows = [(1, f"so it goes {longer} and on"), (2, f"so it goes {joined} and on"), (3, f"so it goes {broken} and on"), (4, asked), (5, tail), (None, longer)]
    got = decontaminate(docs_of(spark, [(i, t, "s") for i, t in rows]), items).collect()
    assert {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in got} == {1: (True, True), 2: (True, True), 3: (False, False), 4: (True, False), 5: (True, False), None: (True, True)}
    assert {r["doc_id"]: r["n_windows"] for r in got}[4] == len(asked.split()) - 7  # of the whole item, once
    names = decontaminate(docs_of(spark, [(1, "x Tom went to Paris y", "s"), (2, "x Eva Lopez went to Paris y", "s")]), spark.createDataFrame([(1, "Tom Smith went to New York")], "item_id long, text string"))
    assert names.where("contaminated").count() == 0  # a short item is not folded to less


def leaks_by_force(docs, items, window=8, least=4, need=3):
    """(doc, item) of consistent alignments: templates, windows, diagonals and slots once more, in plain Python."""
    from quern.llm.decontaminate import MARKS, UNITS

    def words(text):
        return WORD.findall((text or "").translate({ord(c): None for c in MARKS}))

    def template(word):
        low = word.lower()
        if word != low:
            return low if word == word.upper() else "<name>"
        return "<num>" if "0" <= low < ":" else "<unit>" if low in UNITS else low

    def forms_of(text):
        """The words with their templates: as they are, then folded, where that is another form."""
        plain = [(w, template(w)) for w in words(text)]
        short = [p for k, p in enumerate(plain) if not k or (plain[k - 1][1], p[1]) not in (("<name>", "<name>"), ("<num>", "<unit>"))]
        return [plain, short] if len(short) < len(plain) else [plain]

    found = set()
    for item, text in items.items():
        for ifold, own_form in enumerate(forms_of(text)):
            it, il = [t for _, t in own_form], [w.lower() for w, _ in own_form]
            width = window if len(it) >= window else least
            if len(it) < (window if ifold else least):
                continue
            places = range(len(it) - width + 1)
            formed = {p for p in places if sum(not t.startswith("<") for t in it[p : p + width]) >= width // 2}
            enough = min(need if width == window else window, len(places))
            for doc, dtext in docs.items():
                for dfold, doc_form in enumerate(forms_of(dtext)):
                    if dfold and width < window:
                        continue
                    dt, dl = [t for _, t in doc_form], [w.lower() for w, _ in doc_form]
                    hits, forms = collections.defaultdict(set), collections.defaultdict(set)
                    for pos in range(len(dt) - width + 1):
                        for p in places:
                            if p in formed and dt[pos : pos + width] == it[p : p + width]:
                                hits[pos - p].add(p)
                                forms[pos - p].add(p)
                            if not ifold and not dfold and dl[pos : pos + width] == il[p : p + width]:
                                hits[pos - p].add(p)
                    for shift, own in hits.items():
                        first, last = min(own), max(own) + width - 1
                        if len(own) < enough:
                            whole = formed <= forms[shift] and formed and shift >= 0 and len(formed) < enough and dt[shift : shift + len(it)] == it
                            if not whole:
                                continue
                            first, last = 0, len(it) - 1
                        slots = {(it[p], il[p], dl[p + shift]) for p in range(first, last + 1) if it[p].startswith("<")}
                        if len(slots) == len({x[:2] for x in slots}):
                            found.add((doc, item))
    return found


def test_leaks_by_force(spark, real):
    from quern.llm.decontaminate import leaks, unsearched

    rng = random.Random(11)
    names, units, plain = ["Tom", "Anna", "Smith", "NASA", "Lake"], ["kg", "km", "days", "dollars"], [f"w{chr(97 + i)}" for i in range(20)]
    say = lambda n: " ".join(rng.choice(rng.choice([names, units, plain, plain, plain, [str(rng.randrange(90))]])) + rng.choice(["", "", "", ","]) for _ in range(n))
    items = {i: say(rng.choice([3, 4, 5, 7, 8, 9, 14, 30])) for i in range(30)}
    docs = {}
    for d in range(60):
        parts = []
        for i in rng.sample(sorted(items), 2):
            text = items[i].split()
            value = {w: rng.choice([w, w, w, str(rng.randrange(90)) if w.strip(",").isdigit() else w]) for w in text}
            parts += [say(rng.randrange(12)), " ".join(value[w] if rng.random() < 0.97 else "odd" for w in text)]
        docs[d] = " ".join(parts)
    docs |= {1000 + i: t for i, t in list(real.items())[:40]}
    items |= {100 + r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(8).collect()}
    table = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs_of(spark, [(i, t, "s") for i, t in docs.items()]), table).collect()}
    want = leaks_by_force(docs, items)
    assert want and got == want
    assert {r["item_id"] for r in unsearched(table).collect()} == {i for i, t in items.items() if len(t.split()) < 4}


def test_leaks_edge_cases(spark):
    from quern.llm.decontaminate import decontaminate, drop_contaminated

    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = docs_of(spark, EDGE)
    assert decontaminate(docs, items).where("contaminated").count() == 0
    assert decontaminate(docs, items).count() == len(EDGE)
    assert drop_contaminated(docs, items.limit(0)).count() == len(EDGE)
    assert decontaminate(docs.limit(0), items).count() == 0


def test_leaks_are_the_documents_with_ten_words_of_an_item(spark, real):
    from quern.llm.queries import op7_decontaminate

    word = re.compile(r"[^\W_]+")
    split = lambda t: [x.lower() for x in word.findall(t or "")]
    grams = {tuple(w[j : j + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [split(r["text"])] for j in range(len(w) - 9)}
    want = {i for i, t in real.items() if any(tuple(split(t)[j : j + 10]) in grams for j in range(len(split(t)) - 9))}
    assert {r["doc_id"] for r in op7_decontaminate(spark, DATA).where("contaminated").collect()} == want


# ---- secrets


def force_spans(text):
    """The base rules as three passes of a regular expression each."""
    out = []
    name = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for kind, pattern, good in (
        ("assign", rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if good(m)]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_secrets_by_force(spark, real):
    from quern.llm.queries import op9_secret_scan

    for r in op9_secret_scan(spark, DATA).collect():
        want = force_spans(real[r["doc_id"]] or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))


def test_secret_rules_on_random_texts():
    from quern.llm.secrets import BASE_KINDS, Scanner, redact

    rng, scan = random.Random(5), Scanner()
    parts = ["password", "PassWD", "secret", "tokEN", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abc", "ABCDEF1234567", "AKIA", "0123456789abcdef", "é", "İ", "K", "\n", "x" * 7, "token=a", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s for s in scan.spans(text) if s[2] in BASE_KINDS] == force_spans(text), text
    assert redact("a token=abcdef1 b", scan.spans("a token=abcdef1 b")) == "a <assign> b"


def test_checksums():
    from quern.llm.secrets import BASE62, Scanner

    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    n, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        check, n = BASE62[n % 62] + check, n // 62
    kinds = lambda t: {k for _, _, k in Scanner().spans(t)}
    assert "github" in kinds(f"x ghp_{body}{check} y") and "npm" in kinds(f"npm_{body}{check}")
    assert "github" not in kinds(f"x ghp_{body}{check[:-1]}{'0' if check[-1] != '0' else '1'} y")
    assert "iban" in kinds("IBAN: DE89 3704 0044 0532 0130 00") and "iban" not in kinds("IBAN: DE88 3704 0044 0532 0130 00")
    assert "card" in kinds("Visa 4111 1111 1111 1111") and "card" not in kinds("Visa 4111 1111 1111 1112")


def test_numbers_near_other_numbers():
    from quern.llm.secrets import Scanner

    found = lambda t: [t[s:e] for s, e, k in Scanner().spans(t) if k in ("iban", "card")]
    for text, want in (
        ("IBAN DE89370400440532013000 EUR", ["DE89370400440532013000"]),
        ("Visa 4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        ("card 4111111111111111 123", ["4111111111111111"]),
        ("IBAN Number: DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
        ("IBAN (Germany): DE89370400440532013000", ["DE89370400440532013000"]),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("card no. 1: 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("card (exp 12/27) 4111111111111111", ["4111111111111111"]),
        ("card: 4111111111111111, 5555555555554444 and 378282246310005", ["4111111111111111", "5555555555554444", "378282246310005"]),
        ("IBAN XX89370400440532013000", []), ("4111111111111111 alone", []), ("card 41111111111111112222", []),
        ("card " + "4111111111111111 " * 3, ["4111111111111111"] * 3),
    ):
        assert found(text) == want, text


def test_numbers_by_force():
    """A number counts if it begins at most 32 characters after a keyword, or after a number that counts."""
    from quern.llm.secrets import CARD_ISSUERS, IBAN_LENGTHS, NEAR, Scanner

    def card(t, s):
        if not t[s].isdigit() or s and t[s - 1].isdigit():
            return None
        sizes = next((n for first, n in CARD_ISSUERS if first.match(t[s:])), ())
        for n in sizes:
            for e in range(s + n, min(s + 2 * n, len(t) + 1)):
                if re.fullmatch(r"[0-9](?:[ -]?[0-9])*", t[s:e]) and len(d := re.sub("[ -]", "", t[s:e])) == n and not t[e : e + 1].isdigit():
                    if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                        return e
        return None

    def iban(t, s):
        if not re.match("[A-Z]{2}[0-9]{2}", t[s:]) or s and re.match("[0-9A-Za-z]", t[s - 1]):
            return None
        for e in range(s + 15, min(s + 70, len(t) + 1)):
            d = t[s:e].replace(" ", "")
            if re.fullmatch(r"[0-9A-Z](?: ?[0-9A-Z])*", t[s:e]) and len(d) == IBAN_LENGTHS.get(d[:2]) and not re.match("[0-9A-Za-z]", t[e : e + 1]):
                if int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1:
                    return e
        return None

    def force(t):
        out = set()
        for kind, words, end_of in (("card", ("card", "visa"), card), ("iban", ("iban",), iban)):
            ends = [m.end() for w in words for m in re.finditer(w, t.lower())]
            numbers = sorted((s, e) for s in range(len(t)) if (e := end_of(t, s)))
            at = 0
            for s, e in numbers:
                if s >= at and any(x <= s <= x + NEAR for x in ends):
                    out.add((s, e, kind))
                    ends.append(e)
                    at = e
        return out

    rng, scan = random.Random(6), Scanner()
    parts = ["card", "Visa", "IBAN", "mastercard ", " ", ": ", "12/27 ", "4111 1111 1111 1111", "4111111111111111", "5555555555554444", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR76", "GB82WEST12345698765432", "x", "7", "-", "a long gap of some words ", " EUR", "378282246310005", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert {s for s in scan.spans(text) if s[2] in ("iban", "card")} == force(text), text


def test_secrets_in_linear_time():
    import time

    from quern.llm.secrets import Scanner

    for part in ("card ", "card 4", "IBAN DE89 ", "password", "4111111111111111 card ", "token=", "AKIA", "0123456789abcdef", "iban AA00", "visa 4-1-1-1-1-1-1-"):
        began = time.perf_counter()
        Scanner().spans(part * (500_000 // len(part)))
        assert time.perf_counter() - began < 4, part


def test_secret_edge_cases(spark):
    from quern.llm.secrets import scan_secrets

    assert [r["spans"] for r in scan_secrets(docs_of(spark, EDGE)).collect()] == [[]] * len(EDGE)
    assert scan_secrets(docs_of(spark, EDGE).limit(0)).count() == 0


# ---- sharding


def smallest_capacity(sizes, n):
    def needed(cap):
        shards, load = 1, 0
        for s in sizes:
            if load + s > cap:
                shards, load = shards + 1, 0
            load += s
        return shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= n)


def test_capacity_is_the_smallest(spark):
    from quern.llm.sharding import cuts

    rng = random.Random(8)
    for n in (1, 3, 7):
        sizes = [rng.choice((1, 5, 40)) for _ in range(60)]
        groups = spark.createDataFrame(list(enumerate(sizes)), "cell int, bytes long")
        cap, first = cuts(groups, n)
        assert cap == smallest_capacity(sizes, n)
        loads = [sum(sizes[a:b]) for a, b in zip(first, [*first[1:], len(sizes)], strict=True)]
        assert len(first) <= n and max(loads) == cap


def test_kept_columns_that_clash(spark):
    from quern.llm.sharding import shard

    docs = docs_of(spark, EDGE)
    got = shard(docs, shards=3, keep=tuple(docs.columns[1:]))
    assert {"doc_size", "doc_shard", "text", "kept"} <= set(got.columns) and got.count() == len(EDGE)
    assert {r["doc_size"] for r in got.collect()} == {"clash"}


def test_shards(spark):
    from quern.llm.sharding import shard

    rng = random.Random(6)
    rows = [(i, rng.choice(["same text", None, "x" * rng.randrange(60), f"é{i}"]), "s") for i in range(500)]
    got = shard(docs_of(spark, rows).drop("size", "shard"), shards=5, keep=("text",)).collect()
    assert len(got) == len(rows)
    slots, home = collections.defaultdict(list), {}
    for r in got:
        text = r["text"] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
        assert home.setdefault(text, r["shard"]) == r["shard"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard(docs_of(spark, EDGE)).count() == len(EDGE)
    assert shard(docs_of(spark, EDGE).limit(0)).count() == 0


# ---- passages


def test_passages(spark):
    from quern.llm.passages import drop_repeats

    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n)) + "."
    passage = " ".join(say(9) for _ in range(7))
    inside = say(60)[:-1]
    own = [say(30) for _ in range(4)]
    header = "Some short licence line."
    rows = [(1, f"{header}\n{own[0]} {passage} {own[1]}", "s"), (2, f"{header}\n{own[2]} half a sentence {passage}\n{own[3]}", "s"), (3, f"{header}\n{say(60)}", "s"), (4, passage.upper(), "s"), (5, f"{own[0]}", "s"), (6, None, "s"), (7, "", "s"), (8, f"before {inside} behind", "s"), (9, f"other words run into {inside} and on it goes", "s"), (10, f"{own[3][:-1]} ends\nx\n{own[3][:-1]} ends", "s"), (None, passage, None)]
    got = {r["doc_id"]: r for r in drop_repeats(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r, at, kept = got[i], 0, []
        for s in r["removed"]:
            kept.append(text[at : s["start"]])
            at = s["end"]
        assert r["text"] == (None if text is None else "".join([*kept, text[at:]]))
    assert {i for i, _, _ in rows if got[i]["removed"]} == {2, 4, 5, 9, 10, None}
    assert rows[1][1][got[2]["removed"][0]["start"] : got[2]["removed"][0]["end"]].endswith(passage[-60:])
    assert got[2]["text"].startswith(header) and own[3] in got[2]["text"] and got[4]["text"] == "" == got[None]["text"]
    assert len(got[9]["text"].split()) <= 8 + 36 and len(got[10]["removed"]) == 1


def test_passages_by_force(spark, real):
    """Every shared run of 51 words is touched; and whatever is removed stands in an earlier document, or as a line before."""
    from quern.llm.queries import op3_passage_dedup

    words = {i: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", real[i] or "")] for i in sorted(real)}
    runs = lambda i, n: [(k, tuple(w[2] for w in words[i][k : k + n])) for k in range(len(words[i]) - n + 1)]
    got = {r["doc_id"]: [tuple(map(int, s.split(":"))) for s in r["removed"].split(",") if s] for r in op3_passage_dedup(spark, DATA).collect()}
    assert set(got) == set(real)
    long, short = set(), set()
    touched = 0
    for i in words:
        for k, run in runs(i, 51):
            if run in long:
                s, e = words[i][k][0], words[i][k + 50][1]
                assert any(a < e and s < b for a, b in got[i])
                touched += 1
        lines = collections.Counter(" ".join(x.lower().split()) for x in (real[i] or "").split("\n"))
        again = {run for x, n in lines.items() if n > 1 for run in [tuple(x.split()[k : k + 3]) for k in range(len(x.split()) - 2)]}
        for a, b in got[i]:
            inside = [w[2] for w in words[i] if a <= w[0] and w[1] <= b]
            assert len(inside) >= 25
            grams = [tuple(inside[k : k + 3]) for k in range(len(inside) - 2)]
            assert sum(g in short or g in again for g in grams) >= len(grams) * 0.9  # where passages meet, a gram may be new
        long |= {run for _, run in runs(i, 51)}
        short |= {run for _, run in runs(i, 3)}
    assert touched


def test_passages_edge_cases(spark):
    from quern.llm.passages import drop_repeats

    assert drop_repeats(docs_of(spark, EDGE)).count() == len(EDGE)
    assert drop_repeats(docs_of(spark, EDGE).limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert out.columns == docs.columns, name
        before, after = (collections.Counter(r["doc_id"] for r in x.collect()) for x in (docs, out))
        if name == "mixing_sources":
            words = lambda df: collections.Counter(w for r in df.collect() for w in [r["doc_id"]] * len(WORD.findall(r["text"] or "")))  # noqa: E731, B023
            had, has = words(docs), words(out)
            assert set(after) <= set(before) and all(has[i] <= 2 * had[i] for i in has)
        else:
            assert after <= before
        if name == "minhash_near_dedup":
            want = components_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        docs = out
        sizes.append(out.count())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == sizes[-1] > 0
    assert corpus_pipeline.run(spark, d).count() == sizes[-1]


def test_pipeline_edge_cases(spark):
    import corpus_pipeline

    docs = docs_of(spark, EDGE)
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, out, DATA)
            assert done.columns == docs.columns, name
            out = spark.createDataFrame(done.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, out, DATA)
        assert last.count() == out.count() and {"doc_size", "doc_shard", "text"} <= set(last.columns)
    assert docs.count() >= out.count() == 0


def test_pipeline_results_outlive_another_run(spark):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, DATA)
    corpus_pipeline.run(spark, DATA)
    assert first.count() > 0
