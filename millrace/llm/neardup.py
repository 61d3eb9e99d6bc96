"""Near-duplicate detection by bottom-k sketches from one hash function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import HOT_ROWS, free_name, hot_keys, lists_of, lower_words_of, map_batches, scratch, spread_join, written

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Sketch sizes of the first pass, over all documents, and of the second, over those that the first leaves.
K, K2 = 32, 512
#: A pair at PERCENT shares so many of the sketch values but for about one case in a million (binomial tail); higher overlaps miss less.
LEAST, LEAST2 = 17, 393
#: Rounds in which every list that is still in several components is compared with one of its members.
STARS = 3

_STEP = np.uint64(0x9E3779B97F4A7C15)
MEMO = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word)
        return h


class Shingler:
    """Texts to the sorted 64-bit hashes (as signed numbers, Spark's longs) of their distinct shingles."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.memo = _Words()

    def __call__(self, texts: list[str | None]):
        for t in texts:
            words = lower_words_of(t)
            if not words:
                yield np.zeros(0, np.int64)
                continue
            if len(self.memo) > MEMO:
                self.memo.clear()
            h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
            n = min(self.size, len(words))
            out = np.full(len(words) - n + 1, np.uint64(n))
            for i in range(n):
                out = out * _STEP + h[i : len(words) - n + 1 + i]
            yield np.unique(_mix(out).view(np.int64))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, k: int = K) -> DataFrame:
    """id, n_shingles, the set's 128-bit fingerprint (null for an empty set) and its k smallest hashes."""
    schema = [T.StructField("n", T.LongType()), T.StructField("set", T.StringType()), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def make():
        from xxhash import xxh3_128_hexdigest

        shingles = Shingler(size)

        def run(texts):
            out = ([], [], [])
            for s in shingles(texts):
                out[0].append(len(s))
                out[1].append(xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                out[2].append(s[:k])
            return out[0], out[1], lists_of(out[2])

        return run

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), make, schema, ["text"], ["id"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of edges (a, b) reaches.

    Rounds of taking the least label of the neighbours and then that label's own label (pointer jumping), each written to the
    shared folder; minima combine before the shuffle. Where a label is asked for by very many rows (of a hub by its neighbours, of a component's least node
    by its members), these are dealt over many tasks. The rounds end when no label changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = hot_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"])
    labels = both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label"))
    labels = written(labels, "labels")
    many = labels.count() > HOT_ROWS  # else no label can be hot
    for _ in range(max_rounds):
        near = spread_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], hot=hubs).groupBy("a").agg(F.min("label").alias("near")).select(F.col("a").alias("node"), "near")
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        step = written(step, "labels") if many else step
        large = hot_keys(step.groupBy("to").agg(F.count(F.lit(1)).alias("n")), ["to"]) if many else None
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        after = written(spread_join(step, jump, ["to"], "left", large).select("node", "label", F.least("to", "next").alias("new")), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    return labels.select("node", F.col("label").alias("component"))


def _lists(sketched: DataFrame, percent: int, k: int, least: int) -> DataFrame:
    """rep, n, lone, most, value, slot: the inverted lists that each class (rep, n, sketch) enters.

    Values that only one class has lead nowhere. The others are ordered by how many classes have them, and a class enters the lists of its rarest
    values, as many as any sufficient overlap must touch: with need shared values among held, the first held - need + 1 in
    this order, of which the class's lone values are the very first. need is exact where both sets are whole in their sketches, and
    else the binomial bound. Lists are split by set size, in steps of percent, as sets of other sizes cannot link.

    most is the positional filter: where a pair's first shared value stands after so many that are not shared, only a partner of up to so many
    shingles leaves room for the overlap that a link needs.
    """
    values = sketched.select("rep", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    shared = written(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    ranked = spread_join(values, shared, ["value"], hot=hot_keys(shared, ["value"], "df")).groupBy("rep", "n", "held").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # at most k values a class
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.floor(F.col("held") * least / k)).cast("int")
    slot = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.001 + 1e-9)).cast("int")  # a little wider, so that rounding parts no pair
    r = ranked.withColumn("lone", F.col("held") - F.size("v")).withColumn("room", F.col("held") - need + 1 - F.col("lone")).where("room > 0")
    r = r.select("rep", "n", "lone", F.posexplode(F.slice("v", 1, F.least(F.col("room"), F.size("v")))).alias("at", "x"), slot.alias("slot"))
    most = F.when(F.col("n") * 100 <= k * percent, F.floor((F.col("n") - F.col("lone") - F.col("at")) * (100 + percent) / percent) - F.col("n")).otherwise(F.lit(1 << 60))
    return r.select("rep", "n", "lone", most.alias("most"), F.col("x.value").alias("value"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, least: int, hot: DataFrame | None = None) -> DataFrame:
    """The pairs whose sketches may belong to a link: of the k smallest values of both together, least / k are in either."""
    a = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "union"))
    return spread_join(pairs, a, ["a"], hot=hot).join(b, "b").withColumn("union", union).where(shared * k >= F.size("union") * least).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A document's set holds the distinct runs of five words (A-Z lower-cased) of its whole text, or all its words if they are
    fewer. Documents link when 100 * intersection >= percent * union; component_id is the smallest id that links reach.

    1. Documents of equal sets are one class, with the smallest id for its representative: copies, however many, cost one aggregation.
    2. Each class has a bottom-k sketch: the K smallest hashes of its set. Inverted lists (see _lists) of these tell which classes may have
       a partner. For those alone whole sets are made, and inverted lists again of the K2 smallest hashes, which are the whole set
       of most: a class that shares too little with all others enters no list here, however large its family.
    3. In each list the class with the fewest values of its own, likely the others' original, is the head and is compared with all: the union sketch
       estimates the overlap, exact sets confirm. Where this leaves a list in more than one component, other members of the head's
       component are compared with those outside it, for STARS rounds in all or until one finds no link.
    4. For what is then still apart, the differences from the head tell which pairs are worth a comparison (see _apart): pairs that link without
       both being linked to the head must differ from it in the same places. So no list is paired with itself.
    5. Labels spread over the links until they settle, in the shared folder. What is written there on the way is removed at the end.

    Texts that are null, empty or blank have an empty set, link with nothing and are kept. A row without an id takes no part in
    links; its component_id is null and it is kept. Rows that repeat an id share its component, which all of their texts reach. Ids may have any type that has an
    order. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark):
        return written(_near_duplicates(docs, id_col, text_col, percent, size), "near-duplicates", result=True)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    rows = written(sketches(docs, id_col=id_col, text_col=text_col, size=size), "sketches")
    some = rows.where("set is not null and id is not null")
    classes = written(some.groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = hot_keys(classes, ["set"], "copies")
    rough = written(_lists(classes, percent, K, LEAST).select("rep", "value", "slot"), "lists")
    many = rough.groupBy("value", "slot").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    suspects = spread_join(rough, many.select("value", "slot"), ["value", "slot"], hot=hot_keys(many, ["value", "slot"], "members")).select("rep").distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    sets = written(_sets(texts.join(suspects, "rep", "left_semi"), size), "sets")
    # rows that repeat an id with other texts each bring their set; a link of any is a link of the id
    fine = _lists(sets.select("rep", F.size("hashes").cast("long").alias("n"), F.slice("hashes", 1, K2).alias("sketch")), percent, K2, LEAST2)
    fine = written(fine, "lists")
    # what no member of a list is small enough for leaves it
    key = ["value", "slot"]
    least = fine.groupBy(*key).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    fine = written(spread_join(fine, least.drop("members"), key, hot=hot_keys(least, key, "members")).where("most >= least").drop("least"), "lists")
    heads = fine.groupBy(*key).agg(F.min(F.struct("lone", "rep", "n", "most")).alias("h"), F.count(F.lit(1)).alias("members")).where("members > 1").select(*key, "members", F.col("h.rep").alias("a"), F.col("h.n").alias("na"), F.col("h.most").alias("ma"))
    heads = written(heads, "heads")
    hot = hot_keys(heads, key, "members")
    star = spread_join(fine, heads.drop("members"), key, hot=hot).where("rep <> a and n <= ma and na <= most").select("a", F.col("rep").alias("b")).distinct()
    links = _twice(some, classes).unionAll(_linked(star, classes, sets, percent))
    links = written(links, "links")
    found = components(links)
    for turn in range(1, STARS + 1):
        # members of lists in several components, each with its own component and its head's
        placed = spread_join(fine, heads.drop("members"), key, hot=hot).join(found.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        placed = written(placed.select(*key, "rep", "n", "most", "a", "na", F.coalesce("c", "rep").alias("c"), F.coalesce("ca", "a").alias("ca")), "placed")
        split = placed.groupBy(*key).agg(F.max(F.expr("c <> ca")).alias("apart"), F.count(F.lit(1)).alias("members")).where("apart")
        placed = written(spread_join(placed, split.select(*key), key, hot=hot), "placed")
        if turn == STARS:
            break
        other = placed.where("c = ca and rep <> a").groupBy(*key).agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("by"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("most").alias("mx"))).alias("o")).select(*key, "o.x", "o.nx", "o.mx")
        star = spread_join(placed.where("c <> ca"), other, key, hot=hot).where("n <= mx and nx <= most").select(F.col("x").alias("a"), F.col("rep").alias("b")).distinct()
        more = written(_linked(star, classes, sets, percent), "links")
        if not more.limit(1).count():
            break
        links = written(links.unionAll(more), "links")
        found = components(links)
    more = written(_linked(_apart(placed, sets, percent), classes, sets, percent), "links")
    if more.limit(1).count():
        found = components(written(links.unionAll(more), "links"))
    by_set = classes.select("set", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("component"))
    out = spread_join(rows.where("set is not null").select("id", "n", "set"), by_set, ["set"], "left", copied).select("id", "n", "component")
    out = out.unionAll(rows.where("set is null").select("id", "n", F.lit(None).cast(rows.schema["id"].dataType)))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _twice(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the representatives of an id's texts, where an id has more than one."""
    ids = some.groupBy("id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("id")
    mine = some.join(ids, "id", "left_semi").select("id", "set").distinct()
    return mine.join(classes.select("set", "rep"), "set").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))


def _apart(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list and may link, found by how they differ from the list's head h.

    D(x) is the symmetric difference of x and h. |x ^ y| = |D(x) ^ D(y)|, and x and y link if it is at most T = r (|x| + |y|) with
    r = (100 - percent) / (100 + percent). So |D(x) & D(y)| >= (|D(x)| + |D(y)| - T) / 2, and this is above 0, as of two members in different
    components one is not linked to h. Differences are rarer than what a family has in common: lists of them, of one head each and rarest first,
    are short, and what differs from h in places of its own enters none. A member enters the lists of so many of its differences as any
    sufficient overlap must touch; places in this order bound the overlap that is left.
    """
    r = (100 - percent) / (100 + percent)
    m = placed.where("rep <> a").select(F.col("a").alias("h"), F.col("na").alias("nh"), "rep", "n", "c", "ca").distinct()
    m = written(m, "members")
    whole = sets.select("rep", "hashes")
    hot = hot_keys(m.groupBy("h").agg(F.count(F.lit(1)).alias("n")), ["h"])
    d = spread_join(m, whole.select(F.col("rep").alias("h"), F.col("hashes").alias("of_h")), ["h"], hot=hot).join(whole, "rep")
    d = d.select("h", "rep", "c", "ca", F.size("hashes").alias("n"), F.size("of_h").alias("nh"), F.concat(F.array_except("hashes", "of_h"), F.array_except("of_h", "hashes")).alias("d")).where("size(d) > 0")
    d = written(d.withColumn("held", F.size("d")), "differences")
    e = d.select("h", "rep", F.explode("d").alias("value"))
    shared = written(e.groupBy("h", "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    ranked = spread_join(e, shared, ["h", "value"], hot=hot_keys(shared, ["h", "value"], "df")).groupBy("h", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.count(F.lit(1)).alias("shared"))
    # rows that repeat an id have several differences under one rep: their places in the lists are those of all together, so each gets all the room
    x = d.groupBy("h", "rep").agg(F.first("c").alias("c"), F.first("ca").alias("ca"), F.min("n").alias("n"), F.max("n").alias("n_most"), F.first("nh").alias("nh"), F.min("held").alias("held"), F.count(F.lit(1)).alias("texts")).join(ranked, ["h", "rep"])
    limit = F.col("n_most") * (100 - percent) / percent  # T for the largest partner
    near = F.col("held") <= (F.col("n") + F.col("nh")) * r
    need = F.when(near, F.floor(F.col("held") * (1 - r) / 2) + 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("held") - limit - 1e-6)))
    x = x.withColumn("lone", F.col("held") - F.col("shared")).withColumn("room", F.when(F.col("texts") > 1, F.col("shared")).otherwise(F.col("held") - need + 1 - F.col("lone"))).where("room > 0")
    x = x.select("h", "rep", "c", "ca", "n_most", "held", "texts", "lone", F.posexplode(F.slice("v", 1, F.least(F.col("room"), F.col("shared")).cast("int"))).alias("at", "x"))
    x = written(x.select("h", "rep", "c", "ca", "n_most", "held", "texts", (F.col("held") - F.col("lone") - F.col("at")).alias("left"), F.col("x.value").alias("value")), "lists")
    y = x.where("c <> ca").select("h", "value", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n_most").alias("nb"), F.col("held").alias("held_b"), F.col("left").alias("left_b"), F.col("texts").alias("texts_b"))
    enough = 2 * F.least("left", "left_b") + 1e-6 >= F.col("held") + F.col("held_b") - (F.col("n_most") + F.col("nb")) * r
    pairs = x.join(y, ["h", "value"]).where((F.col("c") != F.col("cb")) & ((F.col("c") == F.col("ca")) | (F.col("rep") < F.col("b"))) & (enough | (F.col("texts") + F.col("texts_b") > 2)))
    return pairs.select(F.col("rep").alias("a"), "b").distinct()


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """rep and the whole shingle set of each text."""

    def make():
        shingles = Shingler(size)
        return lambda t: [lists_of(list(shingles(t)))]

    return map_batches(texts, make, [T.StructField("hashes", T.ArrayType(T.LongType()))], ["text"], ["rep"])


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: those that their sketches do not rule out, compared in full."""
    pairs = written(pairs, "pairs")
    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"])  # a head meets a whole family
    pairs = written(_estimated(pairs, classes, K, LEAST, hot), "pairs")
    a, b = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return spread_join(pairs, a, ["a"], hot=hot).join(b, "b").where(both * 100 >= (F.size("ha") + F.size("hb") - both) * percent).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with one document of each component of near_duplicates, and every row without an id.

    Rows that repeat the id of a kept document are one row, that of the first text by code point; an id whose text links to a smaller id goes with all its rows.
    """
    mine, times, row = (free_name(n, docs.columns) for n in ("kept_id", "times", "row"))
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(mine))
    kept = kept.groupBy(mine).agg(F.count(F.lit(1)).alias(times))
    out = docs.join(kept, F.col(f"`{id_col}`") == F.col(mine))
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = out.where(F.col(times) == 1).select(*names)
    if kept.where(F.col(times) > 1).limit(1).count():
        again = out.where(F.col(times) > 1).select(F.struct(*names).alias(row), F.col(mine), F.struct(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.xxhash64(*names)).alias(times))
        single = single.unionAll(again.groupBy(mine).agg(F.min_by(row, times).alias(row)).select(f"{row}.*"))
    return single.unionAll(docs.where(F.col(f"`{id_col}`").isNull()))
