"""Near-duplicate join on word n-grams with a MinHash LSH forest.

Texts are compared by their sets of five-word shingles (words: lower case, cut at white space; a shorter text is one
shingle). Texts with the same set form a class, which one row stands for. Each class has 128 MinHash values in 16 trees;
a tree's eight values are its label, and a tree's labels by prefix are its trie.

Prefixes are matched from the full depth upwards. At each depth, the trie nodes that join two or more branches are met:
pairs of different branches whose 128 values agree well enough (five standard errors of room) are tied; nodes above
`block` members are tied whole, to their smallest member. How alike the pairs met are, as a histogram, tells how many
links the forest has missed so far: a pair of similarity s has a common prefix of depth d in a tree with probability s^d,
so c pairs met stand for c / (trees s^d), and each is missed with (1 - s^d)^trees. Prefixes are shortened by a value until
the links missed are at most 1 - recall of all, and a pair at the threshold is met with 0.99 at least. Tied classes form
candidate groups, whose exact sets are compared.

Groups up to `block` members are compared in one go. A larger group gets a core, the shingles that more than half of its
members have; a member is then only its differences from the core. Two members whose differences have nothing in common
are linked by their sizes alone, so most links are counted from a histogram of sizes. Only members far from the core are
met with the others, in blocks of differences: work grows with members times far members, and no pair becomes a row. Each
link counts once, spanning forests of the links are returned, and their components are the near-duplicate classes.

Edge cases: null and empty texts, and those of white space only, have no shingle: they are copies of each other and link
to nothing; repeated rows are copies; a null doc_id can belong to a class but names it only where there is no other;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, numbered, splittable_join, staged, whole_groups
from .components import components

TREES, DEPTH, VALUES = 16, 8, 128
SPACE = r"[ \t\n\x0B\f\r]+"
MIX, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def met(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of this similarity has a common prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def missed(alike: np.ndarray, depth: int, similarity: float) -> tuple[float, float]:
    """Links, and those among them that no tree has met: estimated from the number of pairs (in each tree) that met with k
    of all values equal, alike[k]."""
    s = np.arange(VALUES + 1) / VALUES
    own = s >= similarity
    links = alike[own] / (TREES * s[own] ** depth)
    return float(links.sum()), float((links * (1 - met(s[own], depth))).sum())


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of hashes of each n words in a row; of all words, if there are fewer."""
    w = words.view(np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ w[k : len(w) - n + 1 + k]) * MIX
            h ^= h >> np.uint64(31)
        h = (h ^ np.uint64(n)) * PRIME
    return np.unique(h ^ (h >> np.uint64(29)))


def _words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
    for pdf in frames:
        sets = [shingles(np.asarray(w, np.int64), n) for w in pdf["words"]]
        labels: list[bytes | None] = [None] * len(sets)
        rows, size = [], 0
        for i, s in enumerate(sets):
            if len(s):
                rows.append(i)
                size += len(s)
            if rows and (size > 60_000 or i == len(sets) - 1):
                x = np.concatenate([sets[r] for r in rows])
                starts = np.cumsum([0] + [len(sets[r]) for r in rows[:-1]])
                out = np.empty((TREES * DEPTH, len(rows)), np.uint16)
                with np.errstate(over="ignore"):
                    for k, m in enumerate(a):
                        least = np.minimum.reduceat((x * m) >> np.uint64(16), starts)
                        out[k] = ((least * PRIME) >> np.uint64(48)).astype(np.uint16)
                for r, column in zip(rows, out.T):
                    labels[r] = column.astype("<u2").tobytes()
                rows, size = [], 0
        yield pd.DataFrame({ROW: pdf[ROW], "doc_id": pdf["doc_id"].astype("Int64"), "key": [_key(s) for s in sets], "labels": labels})


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """For each member of each group, the smallest member that it is tied to. adjacent: groups x members x members."""
    g, m = adjacent.shape[:2]
    adjacent = adjacent | np.eye(m, dtype=bool)
    label = np.broadcast_to(np.arange(m), (g, m)).copy()
    while True:
        new = np.where(adjacent, label[:, None, :], m).min(2)
        new = np.take_along_axis(new, new, 1)
        if (new == label).all():
            return label
        label = new


def _runs(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the groups in a sorted frame."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(pdf)))


GROUP = ["tree", "node"]
TIES = "a long, b long, alike int, n long"


def _tie(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Members of different branches of a node that are similar enough by estimate: a forest of them (a, b), and how many
    pairs have how many values in common (alike, n)."""
    for pdf in whole_groups(frames, GROUP):
        labels = np.frombuffer(b"".join(pdf["labels"]), "<u2").reshape(len(pdf), -1)
        keys, branch = pdf["id"].to_numpy(), pdf["branch"].to_numpy()
        starts, sizes = _runs(pdf, GROUP)
        a, b, alike = [], [], np.zeros(VALUES + 1, np.int64)
        for m in np.unique(sizes):
            own = starts[sizes == m]
            step = max(1, 2_000_000 // (int(m) * int(m) * labels.shape[1]))
            for c in range(0, len(own), step):
                at = own[c : c + step, None] + np.arange(m)
                x, ways = labels[at], branch[at]
                same = np.stack([(x == x[:, k : k + 1]).sum(2) for k in range(m)], 1)
                other = ways[:, :, None] != ways[:, None, :]
                alike += np.bincount(same[other & np.triu(np.ones((m, m), bool), 1)], minlength=VALUES + 1)
                label = _forest(other & (same >= least * VALUES))
                g, k = np.nonzero(label != np.arange(m))
                a.append(keys[at[g, k]])
                b.append(keys[at[g, label[g, k]]])
        if a:
            a, b, seen = np.concatenate(a), np.concatenate(b), np.flatnonzero(alike)
            none = [None] * len(seen)
            columns = {"a": [*a.tolist(), *none], "b": [*b.tolist(), *none], "alike": [None] * len(a) + seen.tolist(), "n": [None] * len(a) + alike[seen].tolist()}
            yield pd.DataFrame(columns, dtype="Int64").astype({"alike": "Int32"})


def _prefix(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("label", 1, 2 * depth))


def _ties_at(leaves: DataFrame, labels: DataFrame, depth: int, least: float, block: int) -> DataFrame:
    """What meets at this depth and not deeper, as TIES."""
    own = leaves.select("id", "tree", _prefix(depth).alias("node"), (F.xxhash64("id") if depth == DEPTH else _prefix(depth + 1)).alias("branch"))
    nodes = own.groupBy(*GROUP).agg(F.count("*").alias("members"), F.min("id").alias("first"), F.min("branch").alias("lo"), F.max("branch").alias("hi"))
    members = staged(splittable_join(own, nodes.filter("members > 1 and lo <> hi").drop("lo", "hi"), *GROUP), "members")
    large = members.filter((F.col("members") > block) & (F.col("id") != F.col("first"))).select(
        F.col("id").alias("a"), F.col("first").alias("b"), F.lit(None).cast("int").alias("alike"), F.lit(None).cast("long").alias("n")
    )
    small = members.filter(F.col("members") <= block).select(*GROUP, "branch", "id").join(labels.hint("merge"), "id")  # merged at any size, see below
    dealt = small.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return staged(large.unionByName(dealt.select(*GROUP, "branch", "id", "labels").mapInPandas(partial(_tie, least=least), TIES)), "ties")


def candidates(reps: DataFrame, similarity: float, recall: float, block: int) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """Edges a, b between classes that may be linked, and for each depth the links there seem to be and those missed so far."""
    leaves = reps.select("id", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    leaves = leaves.select("id", "tree", F.substring("labels", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label"))
    least = similarity - 5 * (similarity * (1 - similarity) / VALUES) ** 0.5
    ties, seen, alike, active, own_labels, floor = [], [], np.zeros(VALUES + 1), None, None, DEPTH // 2
    for depth in range(DEPTH, 0, -1):
        if active is None or depth < floor:  # leaves alone at the floor's depth are alone at all larger ones
            floor = min(floor, depth)
            own = leaves.withColumn("node", _prefix(floor))
            company = own.groupBy(*GROUP).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
            active = staged(splittable_join(own, company, *GROUP).drop("node"), "leaves")
            own_labels = staged(reps.select("id", "labels").join(active.select("id").distinct().hint("merge"), "id", "left_semi"), "labels")
        found = _ties_at(active, own_labels, depth, least, block)
        for r in found.filter("a is null").groupBy("alike").agg(F.sum("n").alias("n")).collect():  # at most VALUES + 1 rows
            alike[r.alike] += r.n
        ties.append(found.filter("a is not null").select("a", "b"))
        seen.append((depth, *missed(alike, depth, similarity)))
        if seen[-1][2] <= (1 - recall) * seen[-1][1] and met(similarity, depth) >= 0.99:
            break
    return reduce(DataFrame.unionByName, ties), seen


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for k in range(i + 1, m):
                out[i, k] = out[k, i] = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    owner, column = owner[shared], place[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float64)
    width = 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (c, c + width))
        x = np.zeros((m, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - c] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


LINKS = "a long, b long, n long"


def _links(keys: np.ndarray, count: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Rows of LINKS: counts (a, n) and a forest (a, b)."""
    some, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(keys)))
    columns = {"a": keys[some].tolist() + keys[tied].tolist(), "b": [None] * len(some) + keys[label[tied]].tolist(), "n": count[some].tolist() + [0] * len(tied)}
    return pd.DataFrame(columns, dtype="Int64")


def _verify(frames: Iterator[pd.DataFrame], n: int, similarity: float) -> Iterator[pd.DataFrame]:
    """By class: its links inside its group, and a forest of the links."""
    for pdf in whole_groups(frames, ["root"]):
        starts, sizes = _runs(pdf, ["root"])
        keys, out = pdf["id"].to_numpy(), []
        for s, m in zip(starts.tolist(), sizes.tolist()):
            sets = [shingles(np.asarray(w, np.int64), n) for w in pdf["words"].iloc[s : s + m]]
            size = np.array([len(x) for x in sets])
            inter = _overlaps(sets)
            link = inter / np.maximum(1, size[:, None] + size[None, :] - inter) >= similarity
            np.fill_diagonal(link, False)
            if link.any():
                out.append(_links(keys[s : s + m], link.sum(1), _forest(link[None])[0]))
        if out:
            yield pd.concat(out, ignore_index=True)


def _sets(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        sets = [shingles(np.asarray(w, np.int64), n).view(np.int64) for w in pdf["words"]]
        yield pd.DataFrame({"id": pdf["id"], "root": pdf["root"], "members": pdf["members"], "shingles": sets})


def _differ(frames: Iterator[pd.DataFrame], p: int, q: int) -> Iterator[pd.DataFrame]:
    """Each member as its differences from the core: the weight of their numbers, and themselves."""
    for pdf in frames:
        rows = []
        for own, core in zip(pdf["shingles"], pdf["core"]):
            own, core = np.asarray(own, np.int64), np.asarray([] if core is None else core, np.int64)
            less, more = np.setdiff1d(core, own, assume_unique=True), np.setdiff1d(own, core, assume_unique=True)
            rows.append((p * len(more) + q * len(less), (q - p) * len(core), np.concatenate([less, more])))
        yield pd.DataFrame({"id": pdf["id"], "root": pdf["root"], "members": pdf["members"]}).join(pd.DataFrame(rows, columns=["weight", "room", "other"], index=pdf.index))


def _cross(frames: Iterator[pd.DataFrame], both: int) -> Iterator[pd.DataFrame]:
    """Members far from the core against others: links that need differences in common."""
    for pdf in whole_groups(frames, ["root", "i", "j"]):
        starts, sizes = _runs(pdf, ["root", "i", "j"])
        for s, m in zip(starts.tolist(), sizes.tolist()):
            part = pdf.iloc[s : s + m]
            side, far, weight, keys = (part[c].to_numpy() for c in ("side", "far", "weight", "id"))
            common = _overlaps([np.asarray(x, np.int64).view(np.uint64) for x in part["other"]])
            need = weight[:, None] + weight[None, :] - part["room"].iat[0]
            link = (side[:, None] == 0) & (side[None, :] == 1) & (keys[:, None] != keys[None, :]) & (need > 0) & (both * common >= need)
            if link.any():
                # a pair of two far members is met twice, and counts for one of them each time
                count = link.sum(1) + np.where(far, 0, link.sum(0))
                names, at = np.unique(keys, return_inverse=True)
                tied = np.zeros((len(names), len(names)), bool)
                x, y = np.nonzero(link)
                tied[at[x], at[y]] = tied[at[y], at[x]] = True
                total = np.zeros(len(names), np.int64)
                np.add.at(total, at, count)
                yield _links(names, total, _forest(tied[None])[0])


def _core_links(big: DataFrame, n: int, similarity: float, block: int) -> DataFrame:
    """LINKS of the groups with more than block members. A link is inter / union >= p / q. With a core of c shingles, members
    that lack m and add a of them, and x differences in common, that is (p + q) x >= p (a + a') + q (m + m') - (q - p) c."""
    ratio = Fraction(similarity).limit_denominator(10_000)
    p, q = ratio.numerator, ratio.denominator
    sets = staged(big.mapInPandas(partial(_sets, n=n), "id long, root long, members long, shingles array<long>"), "sets")
    shared = sets.select("root", "members", F.explode("shingles").alias("e")).groupBy("root", "members", "e").agg(F.count("*").alias("n"))
    cores = staged(shared.filter("2 * n > members").groupBy("root").agg(F.sort_array(F.collect_list("e")).alias("core")), "cores")
    rows = sets.join(cores, "root", "left").select("id", "root", "members", "shingles", "core")
    rows = staged(rows.mapInPandas(partial(_differ, p=p, q=q), "id long, root long, members long, weight long, room long, other array<long>"), "differences")
    # how many members have a weight up to room - weight: running sums over the different weights of a group
    sizes = rows.groupBy("root", "weight").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("room").alias("room"))
    points = sizes.select("root", F.col("weight").alias("at"), F.lit(0).alias("asks"), "n", "weight")
    asks = sizes.select("root", (F.col("room") - F.col("weight")).alias("at"), F.lit(1).alias("asks"), F.lit(0).alias("n"), "weight")
    up_to = Window.partitionBy("root").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    within = points.unionByName(asks).withColumn("near", F.sum("n").over(up_to)).filter("asks = 1").select("root", "weight", "near")
    least = sizes.groupBy("root").agg(F.min(F.struct("weight", "first")).alias("least"))
    near = rows.select("id", "root", "weight", "room").join(staged(within.join(least, "root"), "near"), ["root", "weight"])
    own = F.when(2 * F.col("weight") <= F.col("room"), 1).otherwise(0)
    counts = near.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("near") - own).alias("n"))
    stars = near.filter((F.col("weight") + F.col("least.weight") <= F.col("room")) & (F.col("id") != F.col("least.first"))).select(
        F.col("id").alias("a"), F.col("least.first").alias("b"), F.lit(0).cast("long").alias("n")
    )
    rows = rows.withColumn("far", 2 * F.col("weight") > F.col("room"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    far = staged(rows.filter("far").groupBy("root").agg(F.count("*").alias("n_far")), "far")
    met_by = rows.join(far, "root").withColumn("hash", F.xxhash64("id"))
    one = met_by.filter("far").select("*", F.lit(0).alias("side"), F.pmod("hash", parts("n_far")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts("members") - 1)).alias("j"))
    two = met_by.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), parts("n_far") - 1)).alias("i"), F.pmod("hash", parts("members")).cast("int").alias("j"))
    dealt = one.unionByName(two).select("root", "i", "j", "side", "id", "far", "weight", "room", "other").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return counts.unionByName(stars).unionByName(dealt.mapInPandas(partial(_cross, both=p + q), LINKS))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links for every row: the smallest doc_id of its near-duplicate class, and the number of other
    texts (sets of shingles) that it links to."""
    return _classes(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts"), **how).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each near-duplicate class, that of the smallest doc_id."""
    rows = numbered(docs, "texts")
    return rows.join(staged(_classes(rows, **how).filter("kept").select(ROW), "kept").hint("merge"), ROW, "left_semi").select("doc.*")


def _classes(rows: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, block: int = 256) -> DataFrame:
    """__row, doc_id, class_id, n_links and kept, whether the row stands for its class, for numbered rows."""
    bounded_batches(rows.sparkSession)
    words = rows.select(ROW, F.col("doc.doc_id").cast("long").alias("doc_id"), _words(F.col("doc.text")).alias("words"))
    signed = staged(words.mapInPandas(partial(_sign, n=n), f"{ROW} long, doc_id long, key binary, labels binary"), "signed")
    # a class is named by the number of one of its rows
    reps = staged(signed.filter("labels is not null").groupBy("key").agg(F.min(ROW).alias("id"), F.first("labels").alias("labels")), "classes")
    groups = staged(components(candidates(reps, similarity, recall, block)[0]), "groups")
    wanted = staged(splittable_join(groups, groups.groupBy("root").agg(F.count("*").alias("members")), "root").withColumnRenamed("a", ROW), "wanted")
    # merged at any size, so that plans for small and for large tables are the same
    texts = rows.select(ROW, F.col("doc.text").alias("text")).join(wanted.hint("merge"), ROW)
    texts = staged(texts.select(F.col(ROW).alias("id"), "root", "members", _words(F.col("text")).alias("words")), "candidates")
    dealt = texts.filter(F.col("members") <= block).repartition("root").sortWithinPartitions("root")
    found = dealt.mapInPandas(partial(_verify, n=n, similarity=similarity), LINKS)
    big = texts.filter(F.col("members") > block)
    if not big.isEmpty():
        found = found.unionByName(_core_links(big, n, similarity, block))
    found = staged(found, "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    linked = components(found.filter("b is not null").select("a", "b")).select(F.col("a").alias("id"), "root")
    classes = staged(reps.select("key", "id").join(linked, "id", "left").join(counts, "id", "left").select("key", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")

    # texts without words are one class, which has no row in classes
    placed = signed.select(ROW, "doc_id", "key").join(classes, "key", "left").select(ROW, "doc_id", F.coalesce("root", F.lit(-1)).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = staged(placed, "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", ROW)).alias("first"))
    return splittable_join(placed, first, "root").select(
        ROW, "doc_id", F.col("first.doc_id").alias("class_id"), "n_links", (F.col(ROW) == F.col(f"first.{ROW}")).alias("kept")
    )
