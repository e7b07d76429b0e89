"""Line dedup over a corpus, exact and within a few edits, in DataFrame operations only.

A line counts once in the corpus: of all lines in a class, the one in the document of least doc_id (there,
the first) stays, the others are removed. Classes are the components of "equal after trimming" and "at
most `max_edits` edits apart" (the latter for lines of at least `near_chars` characters).

The edit join partitions a line into max_edits + 1 even segments; a line within the radius has one of them
unchanged at a start that differs by a bounded shift. Lengths come in bands (`BANDS`). All lines of a band cut
segments of the same sizes, those of the left half counted from the start and those of the right half from
the end, and what a line is longer than its band's least length is left between them. So lines of one band
share the keys of outer segments whatever their lengths, and only inner segments are probed at shifts: if
segment i is the first before and in which at most i - 1 edits fall, i - 1 lie before it, none in it and at most
max_edits + 1 - i behind it. Every line posts the segments of its band, keyed by band, and probes the substrings
that the shift bounds allow, also for the bands of lines up to max_edits characters shorter.

Keys that only one distinct line has are found by a pre-aggregated pass over hashes and dropped before any row
meets another. Lines first meet the commonest line of each key; then those meet that aren't yet of one
component. A key that more than `hot` lines post isn't paired off: what remains of its lines without the
shared segment is partitioned again in the same way, until a group is small or what remains has no
segments. Surviving pairs are verified by banded bit-parallel edit distance.

Defined cases: null text stays null, an empty text stays empty; a document whose lines are all repeats
keeps its row with an empty text; rows that share a doc_id count as one document for ownership; rows
without doc_id own a line only if no document with an id has it, and then each keeps it; blank lines and
lines under `min_chars` stay; other columns pass through; an empty table gives an empty result. Line
identity is two 64-bit hashes of the trimmed line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch

MAX_EDITS = 2
MIN_CHARS = 8
NEAR_CHARS = 32
#: (length, width): lines of that length or more come in bands of as many lengths; widths divide the lengths where they begin.
BANDS = ((4, 1), (16, 4), (64, 16))
#: Most shared keys (8 bytes each) that are sent to every executor; more of them meet the lines in a shuffle.
SENT = 1 << 20
_NO_ID = (1 << 63) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """(did, line): lines of all documents, trimmed."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.explode(F.split("text", "\n", -1)).alias("line")).select("did", F.trim("line").alias("line"))


def _identity(line: str) -> dict[str, Column]:
    """Two independent hashes of a line."""
    return {"h": F.xxhash64(line), "g": F.xxhash64(F.lit(1), line)}


def _band(n: Column) -> Column:
    """Least length of the band that holds length n."""
    out = n
    for least, width in BANDS:
        out = F.when(n >= least, n.bitwiseAND(F.lit(-width))).otherwise(out)
    return out


def _keyed(rows: DataFrame, text: str, group: Column, edits: int) -> DataFrame:
    """rows times (_key, idx, start, size) that a text posts (idx 1) and probes.

    Bands and places are exploded one after the other: each step is a short expression over columns of the step
    before, as methods too long for the compiler would be interpreted.
    """
    m = edits + 1
    n, b, q, x = (F.col(c) for c in ("_n", "_b", "_q", "_x"))
    # the text's own band, and those of shorter lines where they are others
    bands = F.array_distinct(F.array(*[_band(F.greatest(n - d, F.lit(0))) for d in range(m)]))
    rows = rows.withColumn("_n", F.length(text)).select("*", F.posexplode(bands).alias("_d", "_b"))
    rows = rows.withColumns({"_q": F.expr(f"cast(_b div {m} as int)"), "_x": b % m})
    places = []
    for i in range(1, m + 1):
        # the last _x segments are one longer; those of the right half are counted from the end
        at = q * (i - 1) + F.greatest(F.lit(0), x - (m + 1 - i)) + 1
        at = at + n - b if 2 * i > m + 1 else at
        size = q + (x >= m + 1 - i).cast("int")
        reach = min(i - 1, m - i)
        places += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), (at + s).alias("start"), size.alias("size")) for s in range(-reach, reach + 1)]
    rows = rows.withColumn("_p", F.explode(F.array(*places))).select("*", "_p.*").drop("_p")
    # a band of fewer characters than segments has one key without any
    fits = F.when(b < m, (F.col("i") == 1) & (F.col("s") == 0)).otherwise((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= n))
    rows = rows.where(fits).withColumn("size", F.when(b < m, 0).otherwise(F.col("size")))
    key = F.xxhash64(group, "i", b, F.substring(F.col(text), F.col("start"), F.col("size")))
    return rows.withColumns({"_key": key, "idx": ((F.col("_d") == 0) & (F.col("s") == 0)).cast("int")}).drop("_n", "_d", "_b", "_q", "_x", "i", "s")


def _without(text: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start + size, F.length(text)))


def _parities(line: str) -> Column:
    """For each of 64 classes of characters and of pairs of neighbours, whether the line has an odd number of them.

    An edit changes two classes of characters and four classes of pairs at most.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)
    step = lambda a, c: F.struct(c.alias("last"), a["one"].bitwiseXOR(bit(F.ascii(c))).alias("one"), a["two"].bitwiseXOR(bit(F.hash(a["last"], c))).alias("two"))
    zero = F.lit(0).cast("long")
    return F.aggregate(_characters(line), F.struct(F.lit("").alias("last"), zero.alias("one"), zero.alias("two")), step, lambda a: F.struct(a["one"].alias("one"), a["two"].alias("two")))


def live_lines(lines: DataFrame, edits: int, sent: int = SENT) -> DataFrame:
    """(h, g, line, n, posts, len, odd): distinct lines that share a key with another one; lines has (h, g, line), repeats allowed.

    posts holds (key, idx, start, size) of the shared keys, n is the number of occurrences times keys; len and odd (parities)
    tell most pairs apart without their texts.
    """
    keyed = _keyed(lines, "line", F.lit(0), edits).withColumnRenamed("_key", "key")
    live = materialize(
        keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z"), F.max("idx").alias("any_idx"))
        .where("a < z and any_idx = 1").select("key"), "line-keys",
    )
    # cutting the keys again costs less than writing them; few of them are shared
    if live.count() <= sent:
        met = keyed.join(F.broadcast(live), "key", "left_semi")
    else:
        # texts travel once for each line that a task holds, not once for each key
        posts = keyed.drop("line", "g").join(live, "key", "left_semi")
        texts = lines.select("h", "g", "line").dropDuplicates(["h"])
        met = posts.join(texts, "h")
    found = met.groupBy("h", "g", "line").agg(F.count("*").alias("n"), F.collect_set(F.struct("key", "idx", "start", "size")).alias("posts"))
    return materialize(found.withColumns({"len": F.length("line"), "odd": _parities("line")}), "line-live")


def _alike(edits: int) -> Column:
    """Whether lines of (len, odd) and (_l, _o) may be within the edits."""
    differ = lambda f: F.bit_count(F.col(f"odd.{f}").bitwiseXOR(F.col(f"_o.{f}")))
    return (F.abs(F.col("len") - F.col("_l")) <= edits) & (differ("one") <= 2 * edits) & (differ("two") <= 4 * edits)


def _pairs(rows: DataFrame, edits: int) -> DataFrame:
    """(u, v) of different roots that may be within the edits: posted lines with those that share the key; pairs of posted lines once."""
    a = rows.where("idx = 1").select("key", F.col("h").alias("u"), F.col("root").alias("_r"), F.col("len").alias("_l"), F.col("odd").alias("_o"))
    b = rows.select("key", F.col("h").alias("v"), "idx", "root", "len", "odd")
    return a.join(b, "key").where(F.expr("_r <> root and (idx = 0 or u < v)") & _alike(edits)).select("u", "v")


def candidate_pairs(live: DataFrame, roots: DataFrame | None, edits: int, hot: int) -> DataFrame:
    """Pairs (u, v) of line hashes that may be within the edits and whose roots differ.

    roots: (h, root) of lines that are known to be of one class; all others are their own root.
    """
    flat = live.select("h", "len", "odd", F.explode("posts").alias("p")).select("h", "len", "odd", "p.*")
    flat = flat.withColumn("root", F.col("h")) if roots is None else flat.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    rows = materialize(flat, "line-posts")
    found = None
    texts = live.select("h", "line")
    while True:
        sizes = materialize(
            rows.groupBy("key").agg(F.sum("idx").alias("n"), F.max("size").alias("cut"), F.min("root").alias("a"), F.max("root").alias("z")).where("a < z and n > 0").select("key", "n", "cut"), "line-sizes",
        )
        # what is left without a segment is `edits` characters long at most (`cut` 0): so few texts share the rest that the alphabet bounds the pairs
        final = (F.col("n") <= hot) | (F.col("cut") == 0)
        small = _pairs(rows.join(sizes.where(final), "key", "left_semi"), edits)
        found = small if found is None else found.union(small)
        big = sizes.where(~final)
        if big.isEmpty():
            return found
        part = rows.join(big, "key", "left_semi")
        if texts is not None:
            part = part.join(texts, "h").withColumn("rest", _without(F.col("line"), F.col("start"), F.col("size"))).drop("line")
            texts = None
        part = materialize(part.select("h", "root", "len", "odd", "rest", "key", F.col("idx").alias("was")), "line-rest")
        deeper = _keyed(part, "rest", F.col("key"), edits)
        deeper = deeper.select("h", "root", "len", "odd", F.col("_key").alias("key"), F.least("was", "idx").alias("idx"), "start", "size", _without(F.col("rest"), F.col("start"), F.col("size")).alias("rest"))
        rows = materialize(deeper.distinct(), "line-posts")


def _let(value: Column, body) -> Column:
    """body(x) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters, or more than edits if it is more.

    Bit-parallel over a diagonal band of 2 * edits + 1 rows: column j of the matrix is two words of vertical
    differences (+1 and -1) for rows j - edits to j + edits, and a step takes some logical operations
    and one addition. The value followed runs down the band's lowest diagonal and then along the last row.
    Lengths must differ by edits at most.
    """
    w = 2 * edits + 1
    ones = F.lit((1 << w) - 1).cast("long")
    m = F.size(a)
    flip = lambda x: x.bitwiseXOR(ones)
    bit = lambda x, i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def step(acc: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        match = F.lit(0).cast("long")
        for i in range(w):
            match = match + F.when(F.get(a, j - edits + i - 1) == c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))

        def with_diagonal(both: Column) -> Column:
            d0, vp, vn = both["d0"], acc["vp"], acc["vn"]
            hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            down = F.shiftrightunsigned(d0, 1)
            row = m - j + edits  # where the last row stands in the band
            at = lambda x: bit(x, F.greatest(row, F.lit(0)))
            score = acc["score"] + F.when(row >= w - 1, 1 - bit(d0, F.lit(w - 1))).otherwise(at(hp) - at(hn))
            return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

        diagonal = lambda p: p.bitwiseAND(acc["vp"]) + acc["vp"]
        d0 = lambda p: diagonal(p).bitwiseXOR(acc["vp"]).bitwiseOR(p).bitwiseOR(acc["vn"]).bitwiseAND(ones)
        return _let(_let(match, lambda p: F.struct(d0(p).alias("d0"))), with_diagonal)

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(edits), m).alias("score"))
    return F.when(F.size(b) == 0, m).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda acc: acc["score"]))


def _cores(pairs: DataFrame) -> DataFrame:
    """pairs with the character arrays s and t without their common start and common end."""
    alike = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    first = pairs.withColumn("_p", alike("s", "t"))
    cut = lambda c: F.when(F.col("_p") == 0, F.array().cast("array<string>")).otherwise(F.reverse(F.slice(c, F.col("_p").cast("int"), F.greatest(F.size(c), F.lit(1)))))
    rest = materialize(first.withColumns({"s": cut("s"), "t": cut("t")}), "line-tails").withColumn("_q", alike("s", "t"))
    end = lambda c: F.when(F.col("_q") == 0, F.array().cast("array<string>")).otherwise(F.reverse(F.slice(c, F.col("_q").cast("int"), F.greatest(F.size(c), F.lit(1)))))
    return rest.withColumns({"s": end("s"), "t": end("t")}).drop("_p", "_q")


def _characters(c: str) -> Column:
    return F.split(c, "")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Those of the pairs (u, v) that are at most `edits` edits apart; texts has (h, line)."""
    a, b = texts.select(F.col("h").alias("u"), F.col("line").alias("s")), texts.select(F.col("h").alias("v"), F.col("line").alias("t"))
    met = pairs.distinct().join(a, "u").join(b, "v").where(F.abs(F.length("s") - F.length("t")) <= edits).select("u", "v", _characters("s").alias("s"), _characters("t").alias("t"))
    # written between the steps: a filter pushed through them would copy each step into the next many times
    cores = materialize(_cores(materialize(met, "line-met")), "line-cores")
    return materialize(cores.select("u", "v", banded_distance(F.col("s"), F.col("t"), edits).alias("d")), "line-distances").where(F.col("d") <= edits).select("u", "v")


def line_links(lines: DataFrame, edits: int = MAX_EDITS, hot: int = 64) -> DataFrame:
    """All verified links (u, v) of distinct lines (h, line) at most `edits` edits apart."""
    live = live_lines(lines.select("line").withColumns(_identity("line")), edits)
    return _verified(candidate_pairs(live, None, edits, hot), live.select("h", "line"), edits)


def line_components(live: DataFrame, edits: int, hot: int) -> DataFrame:
    """(h, root) of lines with a link, root being some member of the component; live as of live_lines.

    First every line of a key meets the commonest line of that key only: this settles large groups of variants of
    one line in as many pairs as they have lines. Then pairs are formed, but only of lines that aren't yet of one
    component, so every link between components is found.
    """
    texts = live.select("h", "line")
    posts = live.select("h", "n", "len", "odd", F.explode("posts.key").alias("key"))
    top = posts.groupBy("key").agg(F.max(F.struct("n", "h", "len", "odd")).alias("top")).select("key", F.col("top.h").alias("u"), F.col("top.len").alias("_l"), F.col("top.odd").alias("_o"))
    stars = _verified(posts.join(top, "key").where((F.col("h") != F.col("u")) & _alike(edits)).select("u", F.col("h").alias("v")), texts, edits)
    roots = materialize(connected_components(stars).withColumnRenamed("node", "h"), "line-roots")
    links = _verified(candidate_pairs(live, roots, edits, hot), texts, edits)
    of = lambda c: roots.select(F.col("h").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    joined = materialize(connected_components(between), "line-joined")
    onto = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    known = roots.join(onto, "root", "left").select("h", F.coalesce("next", "root").alias("root"))
    return known.union(joined.select(F.col("node").alias("h"), "root").join(roots, "h", "left_anti"))


def line_classes(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, hot: int = 64) -> DataFrame:
    """(h, g, class, also, owner): for each line that isn't alone in its class, the least did that has the class (class, also)."""
    lines = _lines(docs).withColumns(_identity("line"))
    near = lines.where(F.length("line") >= max(near_chars, min_chars)).select("h", "g", "line")
    with scratch(docs.sparkSession):
        owners = materialize(lines.where(F.length("line") >= min_chars).groupBy("h", "g").agg(F.min("did").alias("least"), F.max("did").alias("most")), "line-owners")
        live = live_lines(near, edits)
        comp = line_components(live, edits, hot).join(live.select("h", "g"), "h")
        joined = owners.join(comp, ["h", "g"], "left").where("least < most or root is not null").select("h", "g", "least", F.coalesce("root", "h").alias("class"), F.when(F.col("root").isNull(), F.col("g")).otherwise(0).alias("also"))
        root_owner = joined.groupBy("class", "also").agg(F.min("least").alias("owner"))
        return materialize(joined.join(root_owner, ["class", "also"]).select("h", "g", "class", "also", "owner"), "line-classes", keep=True)


def line_dedup(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, hot: int = 64) -> DataFrame:
    """docs with text reduced to its kept lines, plus lines_in and lines_out (longs)."""
    names = [c for c in docs.columns if c not in ("lines_in", "lines_out")]
    classes = line_classes(docs, edits, min_chars, near_chars, hot)
    at = docs.select(
        F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).select("did", "th", "pos", F.trim("line").alias("line"))
    eligible = F.length("line") >= min_chars
    # lines that never count as repeats get a key of their own, so that blank lines don't meet in one task
    own_key = {"h": F.xxhash64("th", "pos"), "g": F.lit(0)}
    at = at.select("did", "th", "pos", eligible.alias("may"), *[F.when(eligible, c).otherwise(own_key[k]).alias(k) for k, c in _identity("line").items()])
    seen = at.join(classes, ["h", "g"], "left").select("did", "th", "pos", F.coalesce("class", "h").alias("class"), F.coalesce("also", "g").alias("also"), "may", F.coalesce(F.col("owner") == F.coalesce("did", F.lit(_NO_ID)), F.lit(True)).alias("own"))
    nth = F.row_number().over(Window.partitionBy("did", "th", "class", "also").orderBy("pos"))
    # rows that repeat both id and text are one here: each position is counted once
    flags = (
        seen.repartition("did", "th").dropDuplicates(["did", "th", "pos"]).withColumn("keep", ~F.col("may") | (F.col("own") & (nth == 1)))
        .groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "keep"))).alias("f"), F.sum((~F.col("keep")).cast("int")).alias("gone"))
        .where("gone > 0").select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.transform("f", lambda x: x["keep"]).alias("_keep"))
    )
    d = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("_t"))
    joined = d.join(flags, F.col("doc_id").cast("long").eqNullSafe(F.col("_did")) & (F.col("_t") == F.col("_th")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.when(F.col("_keep").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: F.get("_keep", i)), "\n"))
    n_in = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    n_out = F.when(F.col("_keep").isNull(), n_in).otherwise(F.size(F.filter("_keep", lambda x: x)).cast("long"))
    cols = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return joined.select(*cols, F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_in).alias("lines_in"), F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_out).alias("lines_out"))


#: The rows of line_dedup with two edits, for DuckDB: thirds share a key; where two lines begin and end to differ there is an edit each, and between them they agree.
ORACLE = """
WITH RECURSIVE doc AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), ln AS (
  SELECT doc_id, i AS pos, parts[i] AS raw, trim(parts[i], ' ') AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM doc)
), near AS (
  SELECT DISTINCT s, length(s) AS n FROM ln WHERE length(s) >= 32
), place AS (
  SELECT s, n, n - d AS k, (n - d) // 3 AS q, d, i, t FROM near, (VALUES (0), (1), (2)) v(d), (VALUES (1, 0), (2, -2), (2, -1), (2, 0), (2, 1), (2, 2), (3, 0)) w(i, t)
), probe AS (
  SELECT s, k, d = 0 AND t = 0 AS own, i, CASE i WHEN 1 THEN left(s, q) WHEN 2 THEN substr(s, q + t + 1, q) ELSE right(s, k - 2 * q) END AS key FROM place
), pair AS (
  SELECT DISTINCT a.s AS a, b.s AS b FROM probe a JOIN probe b ON a.k = b.k AND a.i = b.i AND a.key = b.key AND a.own AND a.s <> b.s
), start AS (
  SELECT a, b, coalesce(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1], length(a) + 1) AS p FROM pair
), tail AS (
  SELECT a, b, substr(a, p) AS x, substr(b, p) AS y FROM start
), cut AS (
  SELECT a, b, x, y, coalesce(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, length(x) + 1 - i, 1) <> substr(y, length(y) + 1 - i, 1))[1], least(length(x), length(y)) + 1) - 1 AS e FROM tail
), core AS (
  SELECT a, b, left(x, length(x) - e) AS x, left(y, length(y) - e) AS y FROM cut
), link AS (
  SELECT DISTINCT a, b FROM core, (VALUES (1, 1), (1, 0), (0, 1)) f(fx, fy), (VALUES (1, 1), (1, 0), (0, 1)) l(lx, ly)
  WHERE (length(x) <= 2 AND length(y) <= 2) OR (length(x) >= fx + lx AND length(y) >= fy + ly AND substr(x, 1 + fx, length(x) - fx - lx) = substr(y, 1 + fy, length(y) - fy - ly))
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), class_of AS (
  SELECT a AS s, least(a, min(b)) AS class FROM reach GROUP BY a
), classed AS (
  SELECT ln.*, length(ln.s) >= 8 AS may, coalesce(class, ln.s) AS class FROM ln LEFT JOIN class_of USING (s)
), owner AS (
  SELECT class, min(doc_id) AS owner FROM classed WHERE may GROUP BY class
), kept AS (
  SELECT doc_id, pos, raw, NOT may OR (doc_id = owner AND row_number() OVER (PARTITION BY doc_id, class, may ORDER BY pos) = 1) AS keep FROM classed LEFT JOIN owner USING (class)
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (keep), '') AS text, count(*) AS lines_in, count(*) FILTER (keep) AS lines_out FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
