"""Fuzzy line deduplication in DataFrame functions alone.

Lines are normalised and deduplicated by two 64-bit hashes.  A distinct line
has a SimHash of its words (a bit is set if over half of the words' hashes set
it).  Two lines are alike if their SimHashes differ in at most ``BITS`` bits and
the edit similarity of their words is at least ``SIMILARITY``.  SimHashes within
three bits agree in two of five blocks of 12 or 13 bits, so each line is filed under
its ten pairs of blocks; files that hold too many lines are split again by four columns
of the bits (the same pigeonhole argument), and once more.  In a file of many lines,
every line is first compared with the file's head, the line with the most exact
copies (of near copies, mostly the one they come from), and only lines near it are kept; the components of those links are found, and only lines of one file that are still apart are compared
with each other.  One occurrence per component stays.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import connected_components, stage

#: Two lines are alike within so many bits of their SimHashes and at so much edit similarity.
SIMILARITY, BITS = 0.8, 3
#: Lines of a file before they are first compared with its head, and before it is split by further blocks.
HEAD_ROWS, SPLIT_ROWS = 64, 2000
#: Words of a line whose bits are added up in the row, in counters of eight bits, before they are summed by line.
GROUP = 8
#: Words of all copies of a line from which the counters of its bits could run over.
MOST_WORDS = 2**30
#: Words of 64 bits, at most, by which a task knows most of the lines that no pair has (a power of two; 16 bytes each).
WORDS = 1 << 19
#: Heads of files, at most, that are sent to every task (four numbers each); more are joined by a shuffle.
HEADS = 1 << 17
#: Bits of a line's number beside which its copies are counted where a file's head is chosen.
ID_BITS = 51
#: Five blocks that cover the word, by their first bit and number of bits, and the ten pairs of them.
CUTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
BLOCKS = [((1 << n) - 1) << at for at, n in CUTS]
PAIRS = [a | b for a, b in combinations(BLOCKS, 2)]
#: Four disjoint masks that cover the word: nibble columns, bit columns.
MASKS = [(0x000F000F000F000F, 4), (0x1111111111111111, 1)]


def normalised(line: Column) -> Column:
    """Lower case; everything but letters and digits is one space."""
    # a to z and 0 to 9 are looked at first, as most characters are one of them
    return F.trim(F.regexp_replace(F.lower(line), r"[[^a-z0-9]&&[^\p{L}\p{N}]]+", " "))


def with_row(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, text)``: row tells apart the texts of one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """``(occ, k1, k2, line)`` of every line with a letter or digit; occ orders occurrences, null ids last."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    # what has a letter or digit isn't empty when normalised; a filter on the normalised line would be pushed below it and normalise twice
    lines = lines.filter(F.col("raw").rlike(r"[\p{L}\p{N}]")).select("doc_id", "row", "at", normalised(F.col("raw")).alias("line"))
    occ = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    return lines.select(occ.alias("occ"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"), "line")


def simhash(over: Column) -> Column:
    """The bits that over half of the words set, from the sums ``c0`` to ``c31`` of two 32-bit counters each.

    ``over`` has 2**30 - 1 less the words in both halves: with twice a counter added, bit 30 is set if the counter is over
    half of the words (of under 2**30).  Both counters are compared at once, and the code stays short enough to be compiled.
    """
    lanes = F.lit(0x0000000100000001).cast("long")
    bits = F.lit(0).cast("long")
    for j in range(32):
        twice = F.shiftleft(F.coalesce(f"c{j}", F.lit(0).cast("long")), 1)
        bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(twice + over, 30).bitwiseAND(lanes), j))
    return bits


def word_groups(lines: DataFrame) -> DataFrame:
    """``(id, k1, k2, first, n, b0 to b7)`` of every GROUP words of a line: n words; ``bj`` has eight counters, of every eighth bit from j on; first is 1 for a line's first row, else 0."""
    words = lines.select("id", "k1", "k2", F.split("line", " ").alias("words"))
    rows = words.select("id", "k1", "k2", "words", F.size("words").alias("of"), F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(GROUP))).alias("at"))
    hashes = [F.when(F.col("at") + i < F.col("of"), F.xxhash64(F.get("words", F.col("at") + i))).otherwise(F.lit(0).cast("long")).alias(f"h{i}") for i in range(GROUP)]
    rows = rows.select("id", "k1", "k2", (F.col("at") == 0).cast("int").alias("first"), F.least(F.lit(GROUP), F.col("of") - F.col("at")).alias("n"), *hashes)
    lanes = F.lit(0x0101010101010101).cast("long")

    def added(j: int) -> Column:
        return reduce(Column.__add__, [F.shiftrightunsigned(f"h{i}", j).bitwiseAND(lanes) for i in range(GROUP)])

    return rows.select("id", "k1", "k2", "first", "n", *[added(j).alias(f"b{j}") for j in range(8)])


def hashed(lines: DataFrame) -> DataFrame:
    """``(id, k1, k2, copies, n, words, simhash)`` of the distinct ones of ``lines(id, k1, k2, line)``: least id, words of a line and of all copies.

    The bits of all copies are added up: of copies, as of one line, over half of the words set a bit.  That holds for
    under MOST_WORDS words.
    """
    lanes = F.lit(0x000000FF000000FF).cast("long")
    counts = word_groups(lines).groupBy("k1", "k2").agg(F.min("id").alias("id"), F.sum("first").alias("copies"), F.sum("n").alias("words"),
                                                        *[F.sum(F.shiftrightunsigned(f"b{j % 8}", j // 8 * 8).bitwiseAND(lanes)).alias(f"c{j}") for j in range(32)])
    over = (F.lit(2**30 - 1).cast("long") - F.col("words")) * F.lit(0x0000000100000001).cast("long")
    return counts.select("id", "k1", "k2", "copies", F.expr("words div copies").cast("int").alias("n"), "words", simhash(over).alias("simhash"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """``(id, k1, k2, copies, n, simhash)`` of the distinct ones of ``lines(id, k1, k2, line)``, staged; id is the least of the copies', n the words.

    A line whose copies have too many words in all for the counters (few lines can have) is hashed again, alone.
    """
    once = stage(hashed(lines), "distinct-lines", free=True)
    many = once.filter(F.col("words") >= MOST_WORDS).select("id")
    if not many.isEmpty():
        alone = hashed(of_ids(lines, many)).select("id", F.col("simhash").alias("own"))
        once = stage(once.join(alone, "id", "left").withColumn("simhash", F.coalesce("own", "simhash")), "distinct-lines", free=True)
    return once.select("id", "k1", "k2", "copies", "n", "simhash")


def near_enough(a: str, b: str) -> Column:
    """SimHashes within BITS bits, and numbers of words that can be SIMILARITY alike; a and b are the columns' names but for ``{}``."""
    few, many = F.least(a.format("n"), b.format("n")), F.greatest(a.format("n"), b.format("n"))
    return (F.bit_count(F.col(a.format("simhash")).bitwiseXOR(F.col(b.format("simhash")))) <= BITS) & (many - few <= most_edits(many))


def most_edits(words: Column) -> Column:
    return F.floor(words * (1 - SIMILARITY) + 1e-9).cast("int")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(masks: list[int]) -> list[Column]:
    return [F.lit(_signed(m)).cast("long") for m in masks]


def _masks(kind: int) -> Column:
    """Four further masks: ``mask`` has the bits that a file's lines share."""
    base, step = MASKS[kind]
    return F.array(*[F.col("mask").bitwiseOR(m) for m in _longs([base << (step * i) for i in range(4)])])


def _filed(rows: DataFrame, masks: Column) -> DataFrame:
    """Each row under each of its masks; ``file`` has the values of the mask's bits."""
    return rows.withColumn("_m", F.explode(masks)).withColumn("mask", F.col("_m")).drop("_m").withColumn("file", F.col("simhash").bitwiseAND(F.col("mask")))


def _pair_files() -> Column:
    """The numbers of a line's ten files: the pair's number, then the bits of its two blocks."""
    bits = [F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in CUTS]
    return F.array(*[F.shiftleft(a, 13).bitwiseOR(b).bitwiseOR(F.lit(i << 26).cast("long")) for i, (a, b) in enumerate(combinations(bits, 2))])


def _pair_mask(file: str) -> Column:
    return F.element_at(F.array(*_longs(PAIRS)), F.shiftrightunsigned(file, 26).cast("int") + 1)


def busy_files(lines: DataFrame) -> list[DataFrame]:
    """``(mask, file, large, top)`` of the files of more than HEAD_ROWS lines, then of the parts of large ones, which have more than SPLIT_ROWS; top: the head's copies and id.

    Of files that aren't split, the number alone tells them apart; mask follows from it.
    """
    found: list[DataFrame] = []
    most = F.lit((1 << 63 - ID_BITS) - 1).cast("long")
    lines = lines.withColumn("top", F.shiftleft(F.least("copies", most), ID_BITS).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << ID_BITS) - 1))))
    rows, keys = files(lines, ["top"], []), ["file"]
    for kind in range(len(MASKS) + 1):
        # at most a file for every HEAD_ROWS rows
        size = rows.groupBy(*keys).agg(F.count("*").alias("lines"), F.max("top").alias("top")).filter(F.col("lines") > min(HEAD_ROWS, SPLIT_ROWS))
        large = (F.col("lines") > SPLIT_ROWS) if kind < len(MASKS) else F.lit(False)  # the last parts stay whole
        mask = F.col("mask") if kind else _pair_mask("file").alias("mask")
        found.append(stage(size.select(mask, "file", large.alias("large"), "top"), "busy-files", free=True))
        if found[-1].filter("large").isEmpty():
            break
        rows = _filed(rows.join(found[-1].filter("large").select("mask", "file"), ["mask", "file"]), _masks(kind))  # what isn't split again needs no count again
        keys = ["mask", "file"]
    return found


def files(lines: DataFrame, also: list[str], busy: list[DataFrame]) -> DataFrame:
    """``(id, n, simhash)``, further columns, ``mask`` and ``file``: each line in its files.

    Lines of too few words for an edit (SIMILARITY allows none) have no file: equal ones are one line already.
    Lines of a large file (``busy_files``) go to the file's parts by further masks instead; a part is told by mask and bits.
    """
    able = lines.filter(most_edits(F.col("n")) > 0).select("id", "n", "simhash", *also)
    rows = able.withColumn("file", F.explode(_pair_files())).withColumn("mask", _pair_mask("file"))
    for kind, some in enumerate(busy[:-1]):  # of the last ones, none is large
        rows = rows.withColumnRenamed("file", "_file").join(some.filter("large").select("mask", F.col("file").alias("_file"), "large"), ["mask", "_file"], "left")
        rows = _filed(rows, F.when(F.col("large"), _masks(kind)).otherwise(F.array("mask")))
        rows = rows.withColumn("file", F.when(F.col("large"), F.col("file")).otherwise(F.col("_file"))).drop("large", "_file")
    return rows


def heads(lines: DataFrame, busy: list[DataFrame]) -> DataFrame:
    """``(mask, file, id_h, n_h, simhash_h)`` of the busy files that aren't split, staged: the head is the line with the most copies."""
    whole = reduce(DataFrame.unionByName, busy).filter("not large").select("mask", "file", F.col("top").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id"))
    whole = stage(whole, "head-ids", free=True)
    own = of_ids(lines.select("id", "n", "simhash"), whole.select("id").distinct())
    return stage(whole.join(own, "id").select("mask", "file", *[F.col(c).alias(f"{c}_h") for c in ("id", "n", "simhash")]), "heads", free=True)


def first_shared(a: str, b: str, mask: Column) -> Column:
    """Whether ``mask`` has the first pair of blocks in which two SimHashes agree: of the files that two lines share, it is true in one (in some, if that one is split)."""
    apart = F.col(a).bitwiseXOR(F.col(b))
    least = reduce(lambda rest, m: F.when(apart.bitwiseAND(m) == 0, m).otherwise(rest), reversed(_longs(PAIRS)), F.lit(0).cast("long"))
    return mask.bitwiseAND(least) == least


def letters(line: Column) -> list[Column]:
    """A line's words as characters, by two independent hashes; U+0100 up to the surrogates."""
    words = F.split(line, " ")

    def coded(seed: int) -> Column:
        code = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), w), F.lit(0xD6FF)) + 0x100), 4, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")

    return [F.size(words).alias("n"), coded(1).alias("x"), coded(2).alias("y")]


def of_ids(lines: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows of ``lines`` whose ``key`` is in ``ids(key)``, few of them, staged and each once.

    Lines are shuffled only if one of up to 64 * WORDS bits, that ids set by their hash and that are sent to every task, is set for them.
    """
    place = F.xxhash64(*key).bitwiseAND(F.lit(64 * WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    set_ = ids.groupBy(F.shiftrightunsigned(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    some = lines.join(F.broadcast(set_), F.shiftrightunsigned(place, 6) == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0)
    # not a semi-join, which Spark would push below the filter
    return some.drop("_word", "_bits").join(ids, list(key))


def alike(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of pairs of ids ``(a, b)``, those whose words are at least SIMILARITY alike; ``lines(id, line)``.

    Similarity is 1 - edits / words of the longer line.  ``levenshtein`` of a
    pair's characters counts the edits; both codings must agree, so words
    that share a character in one of them still differ in the other.
    """
    pairs = stage(pairs, "line-pairs", free=True)
    needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-ids", free=True)
    # staged: a filter on the letters would be pushed below the semi-join and code every line
    texts = stage(of_ids(lines.select("id", "line"), needed).select("id", *letters(F.col("line"))), "line-letters", free=True)
    both = pairs.join(texts.toDF("a", "n_a", "x_a", "y_a"), "a").join(texts.toDF("b", "n_b", "x_b", "y_b"), "b")
    both = both.withColumn("most", most_edits(F.greatest("n_a", "n_b")))
    both = both.filter(F.expr("levenshtein(x_a, x_b, most) >= 0 and levenshtein(y_a, y_b, most) >= 0"))
    return stage(both.select("a", "b"), "line-links", free=True)


def line_parts(lines: DataFrame) -> DataFrame:
    """``(k1, k2, component, copies, several)`` of the distinct ones of ``lines`` (see ``numbered``); several: whether the component has more than one line of all."""
    once = distinct_lines(lines)
    busy = busy_files(once)
    split = len(busy) > 1
    keys = ["file", "mask"] if split else ["file"]  # by file first, as a sort compares the first column's bits, and masks are few
    head = heads(once, busy)
    head = F.broadcast(head) if head.count() <= HEADS else head
    near = files(once, [], busy).join(head if split else head.drop("mask"), keys).filter((F.col("id") != F.col("id_h")) & near_enough("{}", "{}_h"))
    links = alike(near.select(F.least("id", "id_h").alias("a"), F.greatest("id", "id_h").alias("b")).distinct(), lines)
    parts = stage(connected_components(links), "line-parts")

    placed = once.join(parts, once.id == parts.node, "left").select("id", "n", "simhash", F.coalesce("component", "id").alias("part"))
    placed = files(placed, ["part"], busy).select(*keys, "id", "n", "simhash", "part")
    # both sides read the same columns, so their rows are shuffled once
    pairs = placed.alias("l").join(placed.alias("r"), reduce(Column.__and__, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]))
    shared = first_shared("l.simhash", "r.simhash", F.col("l.mask") if split else _pair_mask("l.file"))
    rest = (pairs.filter(near_enough("l.{}", "r.{}") & (F.col("l.id") < F.col("r.id")) & (F.col("l.part") != F.col("r.part")) & shared)
            .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())
    more = alike(rest, lines)
    if not more.isEmpty():
        parts = stage(connected_components(links.unionByName(more)), "line-parts")
    several = F.col("component").isNotNull() | (F.col("copies") > 1)  # only lines with a link have a component here
    return once.join(parts, once.id == parts.node, "left").select("k1", "k2", F.coalesce("component", "id").alias("component"), "copies", several.alias("several"))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (see ``lines_of``) and a number ``id`` of each, staged: they are normalised once, and of most only the hashes are read again."""
    return stage(lines.select(F.monotonically_increasing_id().alias("id"), "*"), "lines")


def line_groups(lines: DataFrame) -> DataFrame:
    """``(k1, k2, component, occ, copies)`` of the distinct lines of ``lines`` (see ``lines_of``); occ is the first occurrence."""
    lines = numbered(lines)
    first = lines.groupBy("k1", "k2").agg(F.min("occ").alias("occ"))
    return line_parts(lines).join(first, ["k1", "k2"]).select("k1", "k2", "component", "occ", "copies")


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, gone array<int>)``: the numbers (from 0) of lines that go, for rows that lose any."""
    lines = numbered(lines_of(with_row(docs)))
    keys = stage(line_parts(lines).filter("several").select("k1", "k2", "component"), "repeated-lines", free=True)
    rows = stage(of_ids(lines.select("k1", "k2", "occ"), keys, ("k1", "k2")).select("component", "occ"), "occurrences", free=True)
    keep = rows.groupBy("component").agg(F.min("occ").alias("keep"))
    gone = rows.join(keep, "component").filter("occ <> keep").select("occ.*")
    return stage(gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone")), "gone-lines", free=True)


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it (names don't tell upper from lower case)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the lines that go, and ``_lines``, ``_gone`` (counts).

    Of each component of alike lines over all documents, the occurrence with
    the smallest (doc_id, text hash, line number) stays; null ids come last.
    Lines without a letter or digit are never removed.  Repeated rows (same id
    and text) are one occurrence and keep or lose the same lines.  A null text
    stays null, a text that loses every line becomes empty, an empty table
    stays empty.  Where ``docs`` has a column ``_lines`` or ``_gone``, the count's
    name gets further underscores in front.
    """
    text = F.col("text").cast("string")
    at, key, lines_name, gone_name = (_free(x, docs.columns) for x in ("_at", "_key", "_lines", "_gone"))
    gone = removed_lines(docs.select("doc_id", "text")).select(F.struct("doc_id", "row").alias(key), F.col("gone").alias(at))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"))
    joined = docs.withColumn(f"_{key}", own).join(gone, F.col(f"_{key}").eqNullSafe(F.col(key)), "left")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(at, i)), "\n")
    columns = [F.when(F.col(at).isNull(), text).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(lines_name),
                         F.coalesce(F.array_size(at), F.lit(0)).cast("long").alias(gone_name))
