"""Near-duplicates by circulant MinHash: two permutations give every signature coordinate.

A document's set (distinct word shingles, A-Z in lower case) is mapped into a universe of D places. One permutation
breaks up structure; of a second one, circularly shifted by k, the least value over the set is coordinate k. The K
values of one place are K neighbouring entries of the second permutation, so a signature is a minimum over rows of a
sliding window. Bands of coordinates make candidates; a link needs the exact Jaccard similarity of the full sets.

Equal sets are gathered first, and one document stands for each; so are buckets of equal members. The documents of a
bucket are then compared in full, in one task, on their full sets: element counts of all pairs come from one pass over
the elements that several of them hold, and only links that join something leave the task. So pairs are never rows,
and no pair of a bucket is left out.

A bucket of more than `block` documents or `elements` elements doesn't go to one task. First all its documents meet its
leader, which gathers most of a large group of near copies in one component. If the bucket then still holds several
components, its documents are cut into blocks, and every pair of blocks is a piece of work of its own, wherever they
are. Only the documents of one component are not compared with each other, as that could join nothing. This grows with
the square of what a bucket holds beside its largest component. What is missed is what shares no bucket.

Cost: texts are read twice (signatures; then full sets, once, of documents that share a bucket); a full set travels once
for each distinct bucket that it is in (blocks: once for each pair). Components are found by spreading the least doc_id
along links with pointer jumping, in tables in the shared folder.

Defined results: no words or no text: an empty set, linked with nothing. Rows that share a doc_id are one document
and should share a text; of repeated rows, each gets the result. A null doc_id can't be a component: such rows are
never linked, their component_id is null and they are kept. Other input columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_texts, written

D = 1 << 17  # places; long texts share some, which only adds candidates


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of the words of a text, all at once.

    A word's bytes are the digits of a number to a fixed odd base, taken modulo 2 ** 64: sums over the text give those of
    all its words. Powers of the base are kept for the longest text so far.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self):
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        powers = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
        self._up, self._down = powers(np.uint64(self.BASE)), powers(np.uint64(pow(self.BASE, -1, 1 << 64)))

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the runs of bytes that are no ASCII blanks."""
        b = np.frombuffer(raw, np.uint8)
        blank = np.ones(len(b) + 2, bool)
        blank[1:-1] = BLANK[b]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(b) >= len(self._up):
            self._grow(2 * len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._up[: len(b)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * GOLD), starts, ends


def shingle_sets(width: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its set: sorted distinct 64-bit hashes of `width`-word shingles."""
    words = Words()

    def run(text: str | None) -> np.ndarray:
        ids = words.of(text.encode("utf-8", "surrogatepass").lower() if text else b"")[0]  # of bytes, A-Z only
        n = max(1, len(ids) - width + 1) if len(ids) else 0
        here = min(width, len(ids))
        out = np.full(n, here, np.uint64)
        for k in range(here):
            out = mixed(out * GOLD + ids[k : k + n])
        return np.unique(out)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Circulant:
    """K-coordinate signatures from two fixed permutations of range(D)."""

    def __init__(self, k: int, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.k, self.first = k, rng.permutation(D).astype(np.uint32)
        second = rng.permutation(D).astype(np.uint32)
        # row p: second[p], second[p + 1], ... : the second permutation at p under shifts 0 .. k - 1
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)

    def signature(self, elements: np.ndarray) -> np.ndarray:
        places = self.first[np.unique((elements % np.uint64(D)).astype(np.int64))]
        least = np.full(self.k, D, np.uint32)
        for at in range(0, len(places), 4096):
            np.minimum(least, self.shifted[places[at : at + 4096]].min(axis=0), out=least)
        return least


def band_keys(signature: np.ndarray, bands: int) -> list[int]:
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64).tolist()


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, digest of the set (null: empty) and band keys."""

    def derive():
        sets, circulant = shingle_sets(width), Circulant(bands * rows)

        def run(texts):
            out: dict[str, list] = {"n_shingles": [], "digest": [], "keys": []}
            for t in texts:
                s = sets(t)
                out["n_shingles"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                out["keys"].append(band_keys(circulant.signature(s), bands) if len(s) else [])
            return out

        return run

    return map_texts(docs, derive, "n_shingles bigint, digest string, keys array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def derive():
        sets = shingle_sets(width)
        return lambda texts: {"elements": [sets(t).tobytes() for t in texts]}

    return map_texts(docs, derive, "elements binary")


def sets_of(ids: DataFrame, docs: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """The full sets of the documents in ids(id), one row each. ids are broadcast if counted to be few enough."""
    n = ids.count()
    texts = docs.join(F.broadcast(ids) if n <= broadcast_rows else ids, docs["doc_id"] == ids["id"], "left_semi")
    sets = written(full_sets(texts, width), "sets")
    return sets if sets.count() == n else written(sets.groupBy("doc_id").agg(F.first("elements").alias("elements")), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of doc_ids to those whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")

    def keep(batches):
        import pyarrow as pa

        for t in batches:
            good = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(keep, "a bigint, b bigint")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """links(a, b) to (id, component): the least id reachable, for every id that has a link.

    start: (id, component) from links seen earlier; their components are joined further.
    """
    if start is not None:
        name = lambda c: start.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        links = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        other = label.select(F.col("id").alias("b"), F.col("component").alias("near"))
        seen = edges.join(other, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = label.join(seen, label["id"] == seen["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("id").alias("j"), F.col("component").alias("further"))
        lower = lower.join(jump, lower["component"] == jump["j"], "left").select("id", "was", F.coalesce("further", "component").alias("component"))
        lower = written(lower, "labels")
        label = lower.select("id", "component")
        if not lower.where("was <> component").limit(1).count():
            break
    if start is None:
        return label
    up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
    old = start.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return written(old.unionByName(label.join(start, "id", "left_anti")), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 2048, elements: int = 1 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id and kept, a row for each row.

    At similarity 0.8, 32 bands of 5 coordinates miss a pair with a probability of 3 in a million; at 0.85, of 6 in a billion.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sign = written(signed(docs, width, bands, rows), "signatures")
    own = sign.where("doc_id is not null and digest is not null")
    alike = written(own.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "sets-of-one")
    members = bucketed(alike.select("id", "n", "keys"), broadcast_rows)
    sets = sets_of(written(members.select("id").distinct(), "wanted"), docs, width, broadcast_rows)

    fits = (F.col("c") <= block) & (F.col("s") <= elements)
    whole = members.where(fits).select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("left"), "id", F.col("id").alias("component"))
    links = tested(whole, sets, percent)
    many = members.where(~fits)
    any_large = bool(many.limit(1).count())
    if any_large:
        links = links.unionByName(linked(star(many, percent), sets, percent))
    component = components(written(links, "links"))
    if any_large:
        rest = written(shared(many, component), "shared")
        if rest.limit(1).count():
            found = written(tested(block_pairs(rest, block, elements), sets, percent), "links")
            if found.limit(1).count():
                component = components(found, component)
    named = alike.join(component, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = sign.drop("keys").join(named, "digest", "left")
    single = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), single).alias("component_id"), F.coalesce(F.col("doc_id") == single, F.lit(True)).alias("kept"))


def bucketed(alike: DataFrame, broadcast_rows: int) -> DataFrame:
    """alike(id, n, keys) to (key, id, n, c, s, lead): members of buckets of several; c counts them, s adds up their n.

    Of buckets with the same members, one stays: counts and two independent hashes over the ids are compared.
    """
    buckets = alike.select("id", "n", F.explode("keys").alias("key"))  # the band is part of a key
    marks = [F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("id")).alias("h"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 32))).alias("g")]
    lead = F.min(F.struct(F.xxhash64("id", F.lit(2)).alias("draw"), "id", "n")).alias("lead")  # the same document in most buckets of a group
    heads = buckets.groupBy("key").agg(*marks, lead).where("c > 1").groupBy("c", "s", "h", "g").agg(F.min("key").alias("key"), F.first("lead").alias("lead"))
    heads = written(heads.select("key", "c", "s", "lead"), "heads")
    if heads.count() <= broadcast_rows:
        heads = F.broadcast(heads)
    return written(buckets.join(heads, "key").select("key", "id", "n", "c", "s", "lead"), "buckets")


def star(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of each member with its bucket's leader, where their set sizes allow a link."""
    fits = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    return members.where(fits & (F.col("id") != F.col("lead.id"))).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def shared(members: DataFrame, component: DataFrame) -> DataFrame:
    """members with their component, of the buckets that more than one component still shares."""
    at = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return at.join(split, "key")


def block_pairs(members: DataFrame, block: int, elements: int) -> DataFrame:
    """members(key, id, n, component) to rows for tested(): each member once for each pair of blocks that it is in.

    Blocks have about `block` documents and `elements` elements. A component that needs several has them to itself;
    such blocks of one component don't meet. The others share blocks.
    """
    parts = lambda c, s: F.greatest(F.ceil(c / block), F.ceil(s / elements))
    own = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("parts", parts(F.col("c"), F.col("s")))
    own = written(own, "shares")
    pool = own.where("parts = 1").groupBy("key").agg(parts(F.sum("c"), F.sum("s")).alias("pool"))
    alone = F.col("parts") > 1
    at = members.join(own.select("key", "component", "parts"), ["key", "component"]).join(pool, "key", "left")
    part = F.pmod(F.when(alone, F.xxhash64("id")).otherwise(F.xxhash64("component")), F.when(alone, F.col("parts")).otherwise(F.col("pool")))
    at = at.select("key", "id", "component", F.when(alone, F.col("component")).alias("owner"), part.alias("part")).withColumn("chunk", F.xxhash64("owner", "part"))
    names = written(at.select("key", "owner", "chunk").distinct(), "chunks")
    x, y = (names.select(F.col("key").alias(f"{c}k"), F.col("owner").alias(f"{c}o"), F.col("chunk").alias(c)) for c in "xy")
    same = F.coalesce(F.col("xo") == F.col("yo"), F.lit(False))
    pairs = written(x.join(y, (F.col("xk") == F.col("yk")) & (F.col("x") <= F.col("y")) & ~same).select(F.col("xk").alias("key"), "x", "y"), "chunk-pairs")
    side = lambda c, of: at.join(of.withColumn("chunk", F.col(c)), ["key", "chunk"]).select("key", "x", "y", F.lit(c == "x").alias("left"), "id", "component")
    return side("x", pairs).unionByName(side("y", pairs.where("x <> y")))


def tested(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows(key, x, y, left, id, component) to links (a, b) that join all that any two documents of a piece link.

    A piece of work is one (key, x, y): with x = y all its documents are compared, else those of the left with the rest.
    Pieces stand together, as rows are dealt and sorted by them, so one is in memory at a time.
    """
    full = rows.join(sets.select(F.col("doc_id").alias("id"), "elements"), "id")
    full = full.select("key", "x", "y", "left", "id", "component", "elements").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches):
        import pyarrow as pa

        held, piece = [], None

        def links():
            found = joining(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for t in batches:
            names = list(zip(*(t.column(c).to_pylist() for c in ("key", "x", "y")), strict=True))
            left, ids, component = (t.column(c).to_pylist() for c in ("left", "id", "component"))
            for i, v in enumerate(t.column("elements")):
                if names[i] != piece:
                    if held:
                        yield links()
                    held, piece = [], names[i]
                held.append((left[i], ids[i], component[i], np.frombuffer(v.as_py(), np.uint64)))
        if held:
            yield links()

    return full.mapInArrow(run, "a bigint, b bigint").distinct()


def joining(held: list[tuple[bool, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """held(left, id, component, elements): the links between different components, as few as join the same."""
    first = np.array([h[0] for h in held])
    found, top = [], {h[2]: h[2] for h in held}

    def up(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    if len(top) > 1:
        for i, j in zip(*similar([h[3] for h in held], first, first if first.all() else ~first, percent), strict=True):
            if (p := up(held[i][2])) != (q := up(held[j][2])):
                top[p] = q
                a, b = held[i][1], held[j][1]
                found.append((min(a, b), max(a, b)))
    return found


def similar(held: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i of first and j of second, of all sets in held with 100 * intersection >= percent * union.

    An element that few sets hold is counted for each two of them, one that many hold by a product of matrices.
    """
    n = np.array([len(x) for x in held])
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    _, column, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(held)), n), often[column]
    few = max(8, min(len(left), len(right)) // 16)
    common = np.zeros(len(left) * len(right), np.int64)
    at = [np.full(len(held), -1), np.full(len(held), -1)]
    for p, side in zip(at, (left, right), strict=True):
        p[side] = np.arange(len(side))

    keep = (often > 1) & (often <= few)
    order = np.argsort(column[keep], kind="stable")
    r, c, o = row[keep][order], column[keep][order], often[keep][order]
    for apart in range(1, few):  # the holders of an element are neighbours: pair those `apart` places apart
        if apart > 1:
            r, c, o = r[o > apart], c[o > apart], o[o > apart]
        if len(r) <= apart:
            break
        same = np.flatnonzero(c[:-apart] == c[apart:])
        for a, b in ((r[same], r[same + apart]), (r[same + apart], r[same])):
            i, j = at[0][a], at[1][b]
            both = (i >= 0) & (j >= 0)
            np.add.at(common, i[both] * len(right) + j[both], 1)
    common = common.reshape(len(left), len(right))

    keep = often > few
    _, c = np.unique(column[keep], return_inverse=True)
    order = np.argsort(c, kind="stable")
    r, c = row[keep][order], c[order]
    width = 2048
    for start in range(0, int(c[-1]) + 1 if len(c) else 0, width):
        lo, hi = np.searchsorted(c, [start, start + width])
        has = np.zeros((len(held), width), np.float32)  # sums of at most `width` ones are exact
        has[r[lo:hi], c[lo:hi] - start] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
    return left[i], right[j]
