"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions alone.

A text's paragraphs (lines, cut again after sentence marks) are a set of 60-bit
digests.  A sketch has ``CELLS`` cells in three parts; a digest falls into one
cell of each part, and a cell holds how many digests it got, their XOR and the
XOR of a check value of each.  Subtracting two sketches cell by cell leaves
only the digests in which the texts differ, however long the texts are.
Peeling reads them: a cell with one digest left (the check agrees) gives that
digest, which is taken out of its other cells, until nothing is left.  A
difference too large for the sketch doesn't peel; it is tried again on a larger
one, dealt by hash over as many sub-tables of ``CELLS`` cells as the texts have
digests for; digests of sub-tables that fail are dealt again by other hashes.
So every difference is found whole, and a row never holds more than two
documents' digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

#: Cells of each of the three parts of a sketch (a power of two), and rounds of peeling, each over one part, before it counts as failed.
PART, ROUNDS = 8, 9
CELLS, PART_BITS = 3 * PART, 3
#: Digests of both texts to a sub-table of a larger sketch, and the fewest sub-tables.
LOAD, FEWEST = 8, 4
#: Levels of larger sketches before giving up with an error (each deals by new hashes, so none should come near).
LEVELS = 30
#: Two primes: the remainders of a digest by both tell all 60-bit digests apart.
P, Q = 2147483647, 2147483629
#: Buckets of neighbouring ids per shuffle partition.
BUCKETS = 4
#: Types of a signed digest (n is 1 or -1) and of a cell.
ENTRY, CELL = "struct<n:bigint,key:bigint>", "struct<n:bigint,key:bigint,chk:bigint>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def paragraphs(text: Column) -> Column:
    """Stretches between line breaks, cut again after ``.``, ``!`` or ``?`` before white space; null has none."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[\x20\x09-\x0D]+", "$1\n")
    return F.filter(F.split(cut, "\n"), lambda p: p != "")


def digest(paragraph: Column) -> Column:
    """The first 60 bits of the paragraph's MD5."""
    return F.conv(F.substring(F.md5(paragraph), 1, 15), 16, 10).cast("long")


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests (a repeated paragraph is one)."""
    return F.array_distinct(F.transform(paragraphs(text), digest))


def _hash(key: Column, seed: int) -> Column:
    """One of a family of universal hashes, 0 to P - 1 (products stay under 2**62)."""
    return ((key % F.lit(P)) * F.lit(pow(48271, seed, P)) + (key % F.lit(Q)) * F.lit(pow(69621, seed, P))) % F.lit(P).cast("long")


def check(key: Column) -> Column:
    """A value that the XOR of several digests doesn't have by chance."""
    return (key % F.lit(P).cast("long")) * (key % F.lit(Q).cast("long"))


def _placed(entries: Column, level: int) -> Column:
    """Signed digests with their check and their cell in each part, from nine bits of one hash."""
    def one(e: Column) -> Column:
        return let(_hash(e["key"], 2 * level + 1), lambda h: F.struct(
            e["n"].alias("n"), e["key"].alias("key"), check(e["key"]).alias("chk"),
            *[F.shiftright(h, PART_BITS * j).bitwiseAND(F.lit(PART - 1)).cast("int").alias(f"c{j}") for j in range(3)]))

    return F.transform(entries, one)


def _cell(n: Column, key: Column, chk: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), chk.alias("chk"))


def signed(keys: Column, sign: int = 1) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).cast("long").alias("n"), k.alias("key")))


def sketch(entries: Column, level: int = 0) -> Column:
    """The cells of signed digests; those of one text all have n = 1."""
    zero, own = F.lit(0).cast("long"), F.sequence(F.lit(0), F.lit(PART - 1))

    def part(placed: Column, j: int) -> Column:
        return F.transform(own, lambda i: F.aggregate(F.filter(placed, lambda e: e[f"c{j}"] == i), _cell(zero, zero, zero), lambda s, e: _cell(
            s["n"] + e["n"], s["key"].bitwiseXOR(e["key"]), s["chk"].bitwiseXOR(e["chk"]))))

    return let(_placed(entries, level), lambda placed: F.concat(*[part(placed, j) for j in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell, ``a`` less ``b``: the sketch of what only one of them has."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"])))


def peel(cells: Column, level: int = 0) -> Column:
    """``struct<cells, found>`` after peeling: signed digests, n is 1 for those of the first text, -1 of the second.

    A round takes the digests that are alone in a cell of one part; a digest has one cell in a part, so it goes once.
    """
    def step(s: Column, turn: Column) -> Column:
        pure = F.transform(F.filter(F.slice(s["cells"], turn % 3 * PART + 1, F.lit(PART)), lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == check(c["key"]))),
                           lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key")))

        def without(placed: Column) -> Column:
            def part(j: int) -> Column:
                return F.transform(F.slice(s["cells"], PART * j + 1, PART), lambda c, i: F.aggregate(F.filter(placed, lambda e: e[f"c{j}"] == i), c, lambda x, e: _cell(
                    x["n"] - e["n"], x["key"].bitwiseXOR(e["key"]), x["chk"].bitwiseXOR(e["chk"]))))

            return F.concat(*[part(j) for j in range(3)])

        def taken(some: Column) -> Column:
            return F.when(F.size(some) == 0, s).otherwise(F.struct(let(_placed(some, level), without).alias("cells"), F.concat(s["found"], some).alias("found")))

        return let(pure, taken)

    start = F.struct(cells.alias("cells"), F.array().cast(f"array<{ENTRY}>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def is_peeled(peeled: Column) -> Column:
    return ~F.exists(peeled["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))


def serialised(cells: Column) -> Column:
    """``n:key:chk`` of each cell, in hex, joined by commas."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["chk"])))), ",")


def peel_larger(entries: Column, level: int) -> Column:
    """``struct<found, open>`` of the signed digests of both texts: what a sketch of many sub-tables shows, and what it left.

    Digests are sorted by the hash that deals them; each sub-table sums its own with their signs (which is
    the difference of the two texts' sub-tables) and is peeled; ``open`` has the digests of those that fail.
    """
    none = F.array().cast(f"array<{ENTRY}>")

    def tried(own: Column) -> Column:
        return let(peel(sketch(own, level), level), lambda p: let(is_peeled(p), lambda ok: F.struct(
            F.when(ok, p["found"]).otherwise(none).alias("found"), F.when(ok, none).otherwise(own).alias("open"))))

    def cut(dealt: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(dealt) - 1), lambda i: (i == 0) | (F.get(dealt, i)["route"] != F.get(dealt, i - 1)["route"]))
        return let(starts, lambda at: F.transform(at, lambda start, j: tried(F.transform(
            F.slice(dealt, start + 1, F.coalesce(F.get(at, j + 1), F.size(dealt)) - start), lambda e: F.struct(e["n"].alias("n"), e["key"].alias("key"))))))

    def whole(all_: Column, tables: Column) -> Column:
        dealt = F.sort_array(F.transform(all_, lambda e: F.struct((_hash(e["key"], 2 * level + 2) % tables).alias("route"), e["n"].alias("n"), e["key"].alias("key"))))
        return let(let(dealt, cut), lambda ts: F.struct(
            F.flatten(F.transform(ts, lambda t: t["found"])).alias("found"), F.flatten(F.transform(ts, lambda t: t["open"])).alias("open")))

    return let(entries, lambda all_: F.when(F.size(all_) == 0, F.struct(none.alias("found"), none.alias("open"))).otherwise(
        let(F.greatest(F.lit(FEWEST), F.ceil(F.size(all_) / LOAD)).cast("long"), lambda tables: whole(all_, tables))))


def recover(rows: DataFrame) -> DataFrame:
    """``(pair, found)`` of ``rows(pair, open)``, signed digests: peeled on larger sketches until none is left."""
    done = []
    for level in range(2, LEVELS):
        tried = stage(rows.select("pair", peel_larger(F.col("open"), level).alias("p")).select("pair", "p.found", "p.open"), f"sketches-{level}")
        done.append(tried.select("pair", "found"))
        rows = tried.filter(F.size("open") > 0).select("pair", "open")
        if rows.isEmpty():
            break
    else:
        raise RuntimeError("sketches that do not peel at any size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("pair").agg(F.flatten(F.collect_list("found")).alias("found"))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """``struct<found, open>`` of two sets of digests and their sketches: on those, else on a larger sketch."""
    none = F.array().cast(f"array<{ENTRY}>")
    return let(peel(subtract(cells_a, cells_b)), lambda p: F.when(is_peeled(p), F.struct(p["found"].alias("found"), none.alias("open"))).otherwise(
        peel_larger(F.concat(signed(a), signed(b, -1)), 1)))


def differences(pairs: DataFrame) -> DataFrame:
    """``(pair, only_a, only_b)`` for ``pairs(pair, a, b)``, sets of paragraph digests: what only one side has.

    pair is unique and not null.  Each pair is tried on sketches of CELLS cells, then on larger ones.  Null sets
    are empty; an empty table gives an empty result; other columns are ignored.
    """
    empty = F.array().cast("array<bigint>")
    rows = pairs.select("pair", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    rows = rows.withColumn("s_a", sketch(signed(F.col("a")))).withColumn("s_b", sketch(signed(F.col("b"))))
    rows = stage(rows.select("pair", difference(F.col("a"), F.col("b"), F.col("s_a"), F.col("s_b")).alias("p")).select("pair", "p.found", "p.open"), "differences")
    late = recover(rows.filter(F.size("open") > 0)).withColumnRenamed("found", "late")
    rows = rows.join(late, "pair", "left").withColumn("found", F.concat("found", F.coalesce("late", F.array().cast(f"array<{ENTRY}>"))))

    def side(sign: int) -> Column:
        return F.transform(F.filter("found", lambda e: e["n"] == sign), lambda e: e["key"])

    return rows.select("pair", side(1).alias("only_a"), side(-1).alias("only_b"))


def changed_paragraphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_id, gone, come)``: the paragraphs of each document that only the old or only the new version has.

    Both tables hold ``doc_id, text``, ids unique and not null; documents of one version only are left out.
    Paragraphs appear once each, in the order of their text.  Other columns are ignored.
    """
    both = (old.select("doc_id", F.col("text").alias("t_a")).join(new.select("doc_id", F.col("text").alias("t_b")), "doc_id"))
    found = differences(both.select(F.col("doc_id").alias("pair"), digests(F.col("t_a")).alias("a"), digests(F.col("t_b")).alias("b")))

    def texts(text: str, only: str) -> Column:
        return F.array_distinct(F.filter(paragraphs(F.col(text)), lambda p: F.array_contains(only, digest(p))))

    return (both.join(found, both.doc_id == found.pair)
            .select("doc_id", texts("t_a", "only_a").alias("gone"), texts("t_b", "only_b").alias("come")))


def _bucket(bounds: list[int], n: int) -> Column:
    """Numbers that ascend with doc_id: 0 to n - 1 of null ids, by text hash; then one more than the bounds below the id."""
    def halve(s: Column, _) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.try_element_at(F.array(*map(F.lit, bounds)), mid + 1) < F.col("doc_id")
        return (F.when(s["lo"] >= s["hi"], s)
                .when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
                .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    null_bucket = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
    return F.when(F.col("doc_id").isNull(), null_bucket).otherwise(n + F.aggregate(steps, start, halve)["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_text)``: the text of the row that follows in descending doc_id; the last is followed by the first.

    Rows are dealt into buckets of neighbouring ids, their number bounded by the shuffle partitions, and ordered in
    each; one further row a bucket carries over the text that follows its last row.  So texts move once.  Null ids come last; rows of
    one id, and those without, follow each other by descending text hash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    docs = docs.withColumn("bucket", _bucket(sorted(set(found or [])), n))
    firsts = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("first")).collect()  # a row a bucket
    firsts = sorted((r.bucket, r.first.doc_id, r.first.h) for r in firsts)
    carried = spark.createDataFrame([(firsts[i][0], *firsts[i - 1][1:]) for i in range(len(firsts))], "to_bucket int, first_id long, first_h long")
    heads = (docs.join(F.broadcast(carried), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
             .groupBy("to_bucket").agg(F.first("text").alias("text")))
    rows = docs.withColumn("extra", F.lit(0)).unionByName(
        heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), F.col("to_bucket").alias("bucket"), F.lit(1).alias("extra")))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("doc_id"), F.desc("h"))
    return rows.withColumn("next_text", F.lead("text").over(order)).filter("extra = 0").select("doc_id", "text", "next_text")


#: What a text is compared with, and the column of that text's digests.
KINDS = (("edited", "e"), ("next", "b"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of each text and of its edited text, and how alike they are to each other and to the next document.

    ``(doc_id, n_chars, edited_sha256, cells, edited_cells, n_paragraphs, near_edited, near_next)``: the edited text
    has its last floor(n_chars / 2) code points replaced by the first as many of the next document (``with_next``).
    Likeness is the share of paragraph digests, of both texts together, that the subtracted sketches show in
    common: 1 for equal sets (two empty ones too).  Null text is empty.  Null and repeated ids keep their
    rows; texts of one id follow each other.  An empty table gives an empty result; other columns are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"),
                       digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("b"))
    for c in "aeb":
        rows = rows.withColumn(f"s_{c}", sketch(signed(F.col(c))))
    for k, c in KINDS:
        rows = rows.withColumn(f"p_{k}", difference(F.col("a"), F.col(c), F.col("s_a"), F.col(f"s_{c}")))
    rows = stage(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", F.col("s_a").alias("cells"), F.col("s_e").alias("edited_cells"),
        *[F.size(c).alias(f"n_{c}") for c in "aeb"],
        *[F.size(f"p_{k}.found").alias(f"d_{k}") for k, _ in KINDS], *[F.col(f"p_{k}.open").alias(f"open_{k}") for k, _ in KINDS]), "fingerprints")
    left = [rows.filter(F.size(f"open_{k}") > 0).select((F.shiftleft("row", 1) + i).alias("pair"), F.col(f"open_{k}").alias("open")) for i, (k, _) in enumerate(KINDS)]
    late = recover(left[0].unionByName(left[1])).select(F.shiftright("pair", 1).alias("row"), F.pmod("pair", F.lit(2)).alias("kind"), F.size("found").alias("d"))
    late = late.groupBy("row").agg(*[F.sum(F.when(F.col("kind") == i, F.col("d"))).alias(f"l_{k}") for i, (k, _) in enumerate(KINDS)])
    rows = rows.drop(*[f"open_{k}" for k, _ in KINDS]).join(late, "row", "left")

    def near(k: str, c: str) -> Column:
        both, d = F.col("n_a") + F.col(f"n_{c}"), F.col(f"d_{k}") + F.coalesce(f"l_{k}", F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / both).alias(f"near_{k}")

    return rows.select("doc_id", "n_chars", "edited_sha256", "cells", "edited_cells", F.col("n_a").alias("n_paragraphs"), *[near(k, c) for k, c in KINDS])
