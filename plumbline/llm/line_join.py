"""Near-equal lines by a segment-partition edit join, on built-in functions only.

Lines within ``EDITS`` edits of each other are linked; connected lines are a class, and all but the class's first
occurrence may be removed. A line of threshold t is cut into t + 1 segments; a line within t edits has at least one of
them unchanged, at a place that the two lengths limit. Segments are indexed by length, number and content; each line
probes the substrings that could match a line of its own length or up to t shorter. Where very many lines have a key,
they are cut into more segments, of which all but t must agree; where they are still many, the differing segments are
cut again in the same way, down to single characters. Pairs that meet and agree in all but t of ``CHECKED`` segments
are verified by the bit-parallel edit distance of the diagonal band, 2 t + 1 bits wide, in 64-bit integers, after their
common ends are cut off. Equal lines are one entry, however often they occur. Lines travel as hashes: the texts of those
that met some other line are looked up again in the documents, through a bitmap of bounded size.

Lines shorter than 20 characters allow one edit and those shorter than 10 none (the shorter line of a pair decides),
so that words are not taken for copies of each other.

Defined cases: null texts and texts without a line that has a word give 0 lines; lines without a word take no part; a
null doc_id ranks after every other as a first occurrence; of equal lines in rows that repeat a doc_id the first row's
comes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed
from .components import components

EDITS = 2
#: Lines of a key that a probe meets right away; those of larger keys are cut finer first.
FEW = 16
#: Segments of lines whose keys are large, and of what keys that are still large leave open.
FINER = 6
#: Segments of the shorter line of a pair, of which all but the allowed edits stand near their place in the longer one.
CHECKED = 20
#: Lines of at least this share of all are joined apart.
COMMON = 0.001
#: Bits of a bitmap for each hash in it, and the power of two that it has at most.
BITS, WIDEST = 16, 29
#: A line allows one edit for each so many characters, up to EDITS.
CHARS_PER_EDIT = 10


def _allowed(length: Column, edits: int) -> Column:
    return F.least(F.lit(edits), F.floor(length / CHARS_PER_EDIT)).cast("int")


def _keys(lines: DataFrame, specs: list[tuple[int, int, int, int]], edits: int) -> DataFrame:
    """(id, key, gap) of lines (id, line, size) for each spec (threshold, gap, segment, shift) that applies. A gap of -1
    stands for the segments of the line itself, which are probes of gap 0 as well."""
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, ("t", "gap", "i", "shift")))) for s in specs))
    rows = lines.select("id", "line", "size", F.inline(listed)).withColumn("other", F.col("size") - F.col("gap"))
    rows = rows.filter(_allowed(F.col("other"), edits) == F.col("t"))
    count = F.col("t") + 1
    base, longer = F.floor(F.col("other") / count).cast("int"), F.col("other") % count
    start = F.col("i") * base + F.greatest(F.lit(0), F.col("i") - count + longer) + F.col("shift")
    size = base + (F.col("i") >= count - longer).cast("int")
    gap = F.when((F.col("gap") == 0) & (F.col("shift") == 0), -1).otherwise(F.col("gap"))
    rows = rows.select("id", "line", "size", "t", "i", "other", gap.alias("gap"), start.alias("start"), size.alias("width"))
    rows = rows.filter("start >= 0 and start + width <= size")
    piece = F.substring("line", F.col("start") + 1, F.col("width"))
    return rows.select("id", F.xxhash64("t", "i", "other", piece).alias("key"), "gap")


def _probe_specs(edits: int) -> list[tuple[int, int, int, int]]:
    """Of the substrings that may equal a segment of a line shorter by ``gap``: i segments lie before it and t - i after
    it, and so many edits can have moved it."""
    return [
        (t, gap, i, shift)
        for t in range(1, edits + 1) for gap in range(t + 1) for i in range(t + 1)
        for shift in range(max(-i, gap - (t - i)), min(i, gap + (t - i)) + 1)
    ]


def _distance(a: Column, b: Column, limit: Column) -> Column:
    """Edit distance of character arrays ``a`` and ``b`` (not longer than ``a``), right where it is at most ``limit``.

    The band's cells of a column are bits of one integer, the lowest diagonal on top; each step moves the band by one
    row. ``limit`` may be at most EDITS and at most either length.
    """
    top = F.lit(-(1 << 63)).cast("bigint")
    rows = F.size(a) - limit
    # the score stands on the lowest diagonal of the band; above this no later step can bring it back to the limit
    hopeless = 2 * limit + F.size(b) - F.size(a)

    def matches(text: Column, j: Column) -> Column:
        bits = F.lit(0).cast("bigint")
        for t in range(2 * EDITS + 1):
            bit = -(1 << 63) if t == 0 else 1 << (63 - t)
            bits = bits.bitwiseOR(F.when(F.get(a, j + limit - t) == text, F.lit(bit)).otherwise(F.lit(0)))
        return bits

    def step(state: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def finish(x: Column) -> Column:
            return _let(_add(x.bitwiseAND(vp), vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn), lambda d0: _let(
                _pair(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)), lambda h: update(d0, h["a"], h["b"])))

        def update(d0: Column, hp: Column, hn: Column) -> Column:
            half = F.shiftrightunsigned(d0, 1)
            # on the diagonal while the band's lowest row is inside, along the last row after that
            mask = F.call_function("shiftrightunsigned", top, F.greatest(F.lit(0), j - rows + 1))
            on = lambda bits: (bits.bitwiseAND(mask) != 0).cast("int")
            score = state["score"] + F.when(j < rows, 1 - on(d0)).otherwise(on(hp) - on(hn))
            return _state(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))), half.bitwiseAND(hp), score)

        return F.when(state["score"] > hopeless, state).otherwise(_let(matches(F.get(b, j), j), finish))

    start = _state(F.call_function("shiftright", top, limit), F.lit(0).cast("bigint"), limit)
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s["score"])


def _state(vp: Column, vn: Column, score: Column) -> Column:
    return F.struct(vp.alias("vp"), vn.alias("vn"), score.cast("int").alias("score"))


def _add(a: Column, b: Column) -> Column:
    """64-bit sum that wraps around, also where ANSI arithmetic would raise: by halves of 32 bits."""
    low32 = F.lit(0xFFFFFFFF).cast("bigint")
    low = a.bitwiseAND(low32) + b.bitwiseAND(low32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(low32), 32).bitwiseOR(low.bitwiseAND(low32))


def _finer_keys(rows: DataFrame, edits: int) -> DataFrame:
    """(id, gap, t, key, line, size, last, a, b, left, right, indexed): rows (id, line, size, gap, t, within, indexed) cut
    into up to FINER parts, with one key for all parts but t (a and b); ``line`` is then what these hold (``left`` and
    ``right`` are its hashes by part), and ``last`` says if they are single characters. A row has many keys, so that rows
    are dealt out before. All are probes; those ``indexed`` are also what probes look for.

    Edits touch at most t parts of the shorter line. What lies before the first of them stands at the same place
    in both lines, what lies after the last one is moved by the difference of lengths, and what lies between (for two
    edits) by ``moved``. A line is probed for each place that the edits allow, once where nothing lies between. Keys
    tell apart rows of different ``within``, the key whose open parts are cut here.
    """
    moves = [(t, gap, moved) for t in range(1, edits + 1) for gap in range(t + 1) for moved in range(-1, 3)
             if abs(moved) + abs(gap - moved) <= t and (moved == 0 or t == 2)]
    listed = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(g).alias("gap"), F.lit(m).alias("moved")) for t, g, m in moves))
    moved = F.transform(F.filter(listed, lambda m: (m["t"] == F.col("t")) & (m["gap"] == F.col("gap"))), lambda m: m["moved"])
    rows = rows.repartition("id", "gap", "within").withColumn("other", F.col("size") - F.col("gap"))
    rows = rows.withColumn("parts", F.least(F.lit(FINER), F.col("other")))
    rows = rows.select("*", F.explode(moved).alias("moved"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - F.col("t"))).alias("a"))
    second = F.when(F.col("t") == 1, F.array("a")).otherwise(
        F.filter(F.sequence(F.col("a") + 1, F.col("parts") - 1), lambda b: (F.col("moved") == 0) | (b > F.col("a") + 1)))
    rows = rows.select("*", F.explode(second).alias("b"))

    def start(part: Column) -> Column:
        return F.floor(part * F.col("other") / F.col("parts")).cast("int")

    def piece(first: Column, end: Column) -> Column:
        return F.substring("line", first + 1, F.greatest(end - first, F.lit(0)))

    one = F.col("t") == 1
    shift = F.when(one, F.col("gap")).otherwise(F.col("moved"))
    before = piece(F.lit(0), start(F.col("a")))
    between = piece(start(F.col("a") + 1) + F.col("moved"), start(F.col("b")) + F.col("moved"))
    after = piece(start(F.col("b") + 1) + F.col("gap"), F.col("size"))
    left = piece(start(F.col("a")), start(F.col("a") + 1) + shift)
    right = F.when(one, F.lit("")).otherwise(piece(start(F.col("b")) + F.col("moved"), start(F.col("b") + 1) + F.col("gap")))
    return rows.select(
        "id", "gap", "t", F.xxhash64("within", "t", "other", "a", "b", before, between, after).alias("key"),
        F.concat(left, right).alias("line"), (F.col("other") <= FINER).alias("last"),
        "a", "b", F.xxhash64(left).alias("left"), F.xxhash64(right).alias("right"),
        (F.col("indexed") & (F.col("gap") == 0) & (F.col("moved") == 0)).alias("indexed"),
    ).withColumn("size", F.char_length("line"))


def _first_meetings(lines: DataFrame, edits: int) -> DataFrame:
    """(other, id, gap, large, indexed): lines that meet in a key, and, with ``large`` and without id, each line in a key
    that more than FEW have; ``indexed`` if it is one of these.

    One shuffle of the keys does both: what a key holds is counted up to FEW + 1 and met within its group. ``lines`` may
    name a line more than once.
    """
    same = Window.partitionBy("key")
    order = same.orderBy("gap", "id")
    keys = _keys(lines, _probe_specs(edits), edits).withColumn("nth", F.dense_rank().over(order))
    # ranked in the order of the key's rows, so that a repeated row stands next to its like
    once = keys.withColumn("before", F.lag("nth").over(order)).filter("before is null or before < nth")
    first = F.when((F.col("gap") < 0) & (F.col("nth") <= FEW + 1), F.col("id"))
    met = once.withColumn("held", F.collect_set(first).over(same)).withColumn("large", F.size("held") > FEW)
    fresh = F.filter("held", lambda q: (F.col("gap") > 0) | (q < F.col("id")))
    found = F.when(F.col("large"), F.array(F.lit(None).cast("long"))).otherwise(fresh)
    return met.select(
        F.col("id").alias("other"), "gap", "large", F.explode(found).alias("id")
    ).withColumn("indexed", F.col("gap") < 0).withColumn("gap", F.greatest("gap", F.lit(0)))


def _meetings(lines: DataFrame, texts: Callable[[DataFrame, str], DataFrame], edits: int) -> DataFrame:
    """(other, id): the pairs of lines (id, line, size) to compare, ``other`` not the shorter; ``texts`` gives the lines
    of ids, each once.

    A probe meets all lines of a key that has up to FEW of them. The lines and probes of larger keys are cut into more
    parts, of which all but ``edits`` have to agree, and of keys that are large then, the parts that need not agree are
    cut in turn, until they are single characters: no pair within the edits is lost, and lines of one key differ in few
    places. Those of a last key have one length and differ in ``edits`` characters at most, so that its size is bounded
    by the alphabet and its pairs of equal length are links.
    """
    first = landed(_first_meetings(lines, edits), "meetings")
    met = [first.filter("not large").select("other", "id")]
    in_large = landed(
        first.filter("large").groupBy(F.col("other").alias("id"), "gap").agg(F.bool_or("indexed").alias("indexed")), "crowded")
    if not in_large.isEmpty():
        held = texts(in_large.select("id").distinct(), "crowded-lines")
        rows = held.join(in_large, "id").select(
            "id", "line", "size", "gap", _allowed(F.col("size") - F.col("gap"), edits).alias("t"), F.lit(0).cast("long").alias("within"), "indexed")
        while True:
            probe = landed(_finer_keys(rows, edits), "finer-keys")
            index = probe.filter("indexed")
            large = _large(index.filter(~F.col("last")))
            met.append(_met(index, probe, large, _once()))
            if large.isEmpty():
                break
            open_keys = _first_keys(probe, large)
            rows = landed(probe.join(open_keys, "key", "left_semi").groupBy(
                "id", "line", "size", "gap", "t", F.col("key").alias("within")).agg(F.bool_or("indexed").alias("indexed")), "open-parts")
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _among(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``name`` is a hash in ``ids`` (id), and few others: those that a broadcast bitmap cannot tell apart."""
    bits = 1 << min(WIDEST, max(15, (BITS * ids.count()).bit_length()))

    def place(x: str) -> Column:
        return F.pmod(x, F.lit(bits)) + 1

    marks = ids.select(
        F.bitmap_bucket_number(place("id")).alias("bucket"), F.bitmap_bit_position(place("id")).alias("at")
    ).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = F.bitmap_bit_position(place(name))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number(place(name))).join(F.broadcast(marks), "bucket")
    return found.filter(F.bit_get(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _large(index: DataFrame) -> DataFrame:
    return landed(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("key"), "large-keys")


def _once() -> Column:
    """Lines that differ in one part only have a key in common with each other part; they meet at the first part's."""
    a, b = F.col("p.a"), F.col("p.b")
    same_left, same_right = F.col("p.left") == F.col("q.left"), F.col("p.right") == F.col("q.right")
    return (F.col("p.t") == 1) | (~(same_left & (a != 0)) & ~(same_right & ((a != 0) | (b != 1))))


def _first_keys(probe: DataFrame, large: DataFrame) -> DataFrame:
    """Of the ``large`` keys, those that hold lines which ``_once`` lets meet there; probes include the lines looked for."""
    varies = probe.join(large, "key", "left_semi").groupBy("key").agg(
        F.first("t").alias("t"), F.first("a").alias("a"), F.first("b").alias("b"),
        (F.min("left") < F.max("left")).alias("left"), (F.min("right") < F.max("right")).alias("right"))
    first = (F.col("left") | (F.col("a") == 0)) & (F.col("right") | ((F.col("a") == 0) & (F.col("b") == 1)))
    return landed(varies.filter((F.col("t") == 1) | first).select("key"), "open-keys")


def _met(index: DataFrame, probe: DataFrame, large: DataFrame, where: Column) -> DataFrame:
    """(other, id) of probes and lines with one key that is not ``large``; lines of equal length meet once."""
    near = index.join(large, "key", "left_anti").alias("q")
    fresh = (F.col("p.gap") > 0) | (F.col("q.id") < F.col("p.id"))
    on = (F.col("p.key") == F.col("q.key")) & fresh & where
    return probe.alias("p").join(near, on).select(F.col("p.id").alias("other"), F.col("q.id").alias("id"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(p: Column, q: Column, limit: Column) -> Column:
    """Edit distance of two texts, ``p`` not the shorter, right where it is at most ``limit``; greater elsewhere."""

    def first_difference(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")

    def headless(s: Column) -> Column:
        return _let(F.least(first_difference(s["a"], s["b"]), F.size(s["b"])), lambda n: _pair(
            F.slice(s["a"], n + 1, F.size(s["a"]) - n), F.slice(s["b"], n + 1, F.size(s["b"]) - n)))

    def core(s: Column) -> Column:
        tail = F.least(first_difference(F.reverse(s["a"]), F.reverse(s["b"])), F.size(s["b"]))
        return _let(tail, lambda n: _pair(F.slice(s["a"], 1, F.size(s["a"]) - n), F.slice(s["b"], 1, F.size(s["b"]) - n)))

    def distance(s: Column) -> Column:
        a, b = s["a"], s["b"]
        # the band needs more characters than edits; shorter cores are compared directly
        return (
            F.when(F.size(a) - F.size(b) > limit, F.lit(1 << 20))
            .when(F.size(b) <= limit, F.levenshtein(F.array_join(a, ""), F.array_join(b, "")))
            .otherwise(_distance(a, b, limit))
        )

    return _let(_pair(_chars(p), _chars(q)), lambda s: _let(headless(s), lambda t: _let(core(t), distance)))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _chars(text: Column) -> Column:
    """The characters of a text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _alike(p: Column, q: Column, limit: Column) -> Column:
    """False only where ``q`` (not the longer) cannot be within ``limit`` edits of ``p``: each edit touches one of
    ``CHECKED`` segments at most, and the others stand in ``p`` up to EDITS places away."""
    size = F.char_length(q)

    def start(i: int) -> Column:
        return F.floor(i * size / CHECKED).cast("int")

    found = F.lit(0)
    for i in range(CHECKED):
        low = F.greatest(start(i) - EDITS, F.lit(0))
        around = F.substring(p, low + 1, start(i + 1) + EDITS - low)
        found = found + F.contains(around, F.substring(q, start(i) + 1, start(i + 1) - start(i))).cast("int")
    return found >= CHECKED - limit


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """Of pairs with lines ``p`` (the longer) and ``q``, those within what the shorter line allows."""
    limit = _allowed(F.char_length("q"), edits)
    alike = pairs.filter(_alike(F.col("p"), F.col("q"), limit))
    return alike.filter(edit_distance(F.col("p"), F.col("q"), limit) <= limit)


def shared_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS
) -> tuple[DataFrame, DataFrame]:
    """All lines that have a word (doc_id, row, line_no; documents without one have one row with a null line_no), and of
    those the ones in classes of more than one occurrence: doc_id, row, line_no, links, class, first (is it kept?).
    """
    spark = docs.sparkSession
    lines = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    ).select("doc_id", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    worded = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    mark = {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}
    # rows have their numbers from this table only
    seen = landed(
        lines.filter(worded | (F.col("line_no").isNull()) | (F.col("line_no") == 0)).withColumns(mark)
        .select("doc_id", "row", F.when(worded, F.col("line_no")).alias("line_no"), "h1", "h2"), "lines")
    repeated = landed(
        seen.filter("line_no is not null").groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
        .withColumn("alone", -1 - F.monotonically_increasing_id()), "repeated-lines")
    every = docs.select(F.explode(F.split(column(text), "\n", -1)).alias("line")).filter(worded).withColumns(mark)

    def texts(ids: DataFrame, label: str) -> DataFrame:
        near = _among(every, "h1", ids).groupBy("h1", "h2").agg(F.first("line").alias("line"))
        return landed(near.withColumn("id", F.col("h1")).join(ids, "id", "left_semi").withColumn("size", F.char_length("line")), label)

    # an id is half of a line's mark; lines that share it are told apart when pairs are checked
    pairs = landed(_meetings(_mostly_once(every, repeated, seen.count()), texts, edits), "line-pairs")
    wanted = landed(pairs.select("id").union(pairs.select("other")).distinct(), "met-lines")
    found = landed(texts(wanted, "line-texts").withColumn("number", F.monotonically_increasing_id()), "numbered-lines")
    longer = found.select(F.col("id").alias("other"), F.col("number").alias("b"), F.col("line").alias("p"))
    shorter = found.select("id", F.col("number").alias("a"), F.col("line").alias("q"))
    both = pairs.join(longer, "other").join(shorter, "id").filter(F.char_length("p") >= F.char_length("q"))
    links = landed(within(both, edits).select("a", "b"), "line-links")
    labels = components(links) if not links.isEmpty() else spark.createDataFrame([], "node long, label long")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = labels.join(degree, "node").join(found.select(F.col("number").alias("node"), "h1", "h2"), "node")
    # lines that occur once and have no link are their own class; only the others are looked up
    known = landed(repeated.join(linked, ["h1", "h2"], "full_outer").select(
        "h1", "h2", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.coalesce("label", "alone").alias("class"), F.coalesce("n", F.lit(1).cast("long")).alias("n")), "shared-lines")
    placed = landed(_placed(seen.filter("line_no is not null"), known), "placed-lines")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line_no")
    kept = placed.groupBy("class").agg(F.min(order).alias("best")).select("best.row", "best.line_no", F.lit(True).alias("first"))
    # by place, not by class, which may hold very many lines
    found = placed.join(kept, ["row", "line_no"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return seen.drop("h1", "h2"), found


def _mostly_once(every: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """Lines (id, line, size); those that make up a share of ``COMMON`` of all are named once, others as they occur."""
    common = landed(repeated.filter(F.col("n") > COMMON * total).select("h1", "h2"), "common-lines")
    lines = every
    if not common.isEmpty():
        one = landed(every.join(F.broadcast(common), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")), "common-texts")
        lines = every.join(F.broadcast(common), ["h1", "h2"], "left_anti").unionByName(one)
    return lines.select(F.col("h1").alias("id"), "line", F.char_length("line").alias("size"))


def _placed(seen: DataFrame, known: DataFrame) -> DataFrame:
    """The occurrences of the lines of ``known``; lines that make up a share of ``COMMON`` of all, of which there are
    1 / COMMON at most, are broadcast, so that no task gets all occurrences of one."""
    common = F.col("n") > COMMON * seen.count()
    often = F.broadcast(known.filter(common))
    rest = seen.join(often.select("h1", "h2"), ["h1", "h2"], "left_anti").join(known.filter(~common), ["h1", "h2"])
    return seen.join(often, ["h1", "h2"]).unionByName(rest).select("doc_id", "row", "line_no", "links", "class")


def duplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_links, n_removed, and the removed line numbers."""
    lines, shared = shared_lines(docs, text, doc_id, edits)
    gone = ~F.col("first")
    counted = lines.groupBy("row", "doc_id").agg(F.count("line_no").alias("n_lines"))
    found = shared.groupBy("row").agg(
        F.sum("links").alias("n_links"), F.count_if(gone).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(gone, F.col("line_no")))).alias("removed"))
    nothing = {"n_links": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.array().cast("array<int>")}
    return counted.join(found, "row", "left").select(
        "doc_id", "n_lines", *(F.coalesce(name, value).alias(name) for name, value in nothing.items()))


def without_lines(text: Column, removed: Column) -> Column:
    """The text with the numbered lines left out."""
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(removed, i))
    return F.array_join(kept, "\n")
