"""SimHash fingerprints of whole texts and the search for near ones, in DataFrame functions alone.

Each word is hashed to 128 bits, and each bit votes for or against with the word's weight. Two bits' votes share a long
while they are summed. Near fingerprints are found in permuted block tables: with five blocks and at most three bits of
difference, two blocks are equal, so a table for each pair of blocks holds every near pair under one key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.operators.global_order import global_index

RADIUS = 3
#: (which long, first bit, bits) of each block.
BLOCKS = ((0, 0, 22), (0, 22, 21), (0, 43, 21), (1, 0, 32), (1, 32, 32))
#: Each table is keyed by two of the blocks.
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
#: So many fingerprints of one key meet as one array.
BLOCK = 128
_LANES = 0x0000000100000001
_WORDS = r"[\x20\x09-\x0D]+"


def weight(word: Column) -> Column:
    """Longer words are rarer, and weigh more: one less than their length, from 1 to 15; no word weighs nothing."""
    n = F.char_length(word)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.lit(15)))).cast("bigint")


def votes(words: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """``keys, fp0, fp1``: the SimHash of each group of words. A bit is set if more than half of the weight votes for it.

    Groups that hold nothing but empty words get zero.
    """
    hashed = words.select(*keys, F.xxhash64(word).alias("_h0"), F.xxhash64(word, F.lit(1)).alias("_h1"), weight(F.col(word)).alias("_w"))
    sums = [
        F.sum(F.shiftrightunsigned(f"_h{i}", k).bitwiseAND(_LANES) * F.col("_w")).alias(f"_s{i}_{k}") for i in (0, 1) for k in range(32)
    ]
    summed = hashed.groupBy(*keys).agg(F.sum("_w").alias("_all"), *sums)

    def bits(i: int) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(32):
            s = F.col(f"_s{i}_{k}")
            low = s.bitwiseAND(0xFFFFFFFF) * 2 > F.col("_all")
            high = F.shiftrightunsigned(s, 32) * 2 > F.col("_all")
            out = out.bitwiseOR(F.when(low, F.lit(1 << k)).otherwise(0)).bitwiseOR(F.when(high, F.shiftleft(F.lit(1).cast("bigint"), k + 32)).otherwise(0))
        return out

    return summed.select(*keys, bits(0).alias("fp0"), bits(1).alias("fp1"))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def as_text(fp0: Column, fp1: Column) -> Column:
    """32 lowercase hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(fp0), 16, "0"), F.lpad(F.hex(fp1), 16, "0")))


def _blocks(fp0: Column, fp1: Column) -> list[Column]:
    return [F.shiftrightunsigned((fp0, fp1)[i], a).bitwiseAND((1 << n) - 1) for i, a, n in BLOCKS]


def _tables(prints: DataFrame) -> DataFrame:
    """``table, key, row``: each fingerprint under its key in each block table."""
    own = _blocks(F.col("fp0"), F.col("fp1"))
    keys = F.array(*[F.xxhash64(F.lit(t), own[i], own[j]) for t, (i, j) in enumerate(PAIRS)])
    return prints.select(F.posexplode(keys).alias("table", "key"), F.struct(*prints.columns).alias("row"))


def _meet_first(a: Column, b: Column, table: Column) -> Column:
    """Whether ``table`` is the first one in which two fingerprints share a key; so a pair counts once."""
    x, y = _blocks(a["fp0"], a["fp1"]), _blocks(b["fp0"], b["fp1"])
    return F.coalesce(*[F.when((x[i] == y[i]) & (x[j] == y[j]), t) for t, (i, j) in enumerate(PAIRS)]) == table


def _checked(radius: int) -> int:
    if not 0 < radius <= len(BLOCKS) - 2:
        raise ValueError("five blocks serve a radius of up to three bits")
    return radius


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of distinct fingerprints (``fp0, fp1``) that differ in 1 to ``radius`` (at most 3) bits, each once.

    Other columns are carried along for both sides: ``a`` and ``b`` are structs of a row's columns. The result is as long
    as there are such pairs; ``near_counts`` only counts them.
    """
    _checked(radius)
    rows = _tables(prints)
    a, b = rows.withColumnRenamed("row", "a"), rows.select(F.col("table").alias("table_b"), F.col("key").alias("key_b"), F.col("row").alias("b"))
    order = F.struct("a.fp0", "a.fp1") < F.struct("b.fp0", "b.fp1")
    near = distance(F.col("a.fp0"), F.col("a.fp1"), F.col("b.fp0"), F.col("b.fp1")) <= radius
    met = (F.col("key") == F.col("key_b")) & (F.col("table") == F.col("table_b")) & order & near & _meet_first(F.col("a"), F.col("b"), F.col("table"))
    return a.join(b, met).select("a", "b")


def near_counts(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``fp0, fp1, near``: how many other documents have a fingerprint within ``radius`` bits (equal ones included).

    ``prints`` has a fingerprint a row, and the number ``n`` of documents that have it. No pair becomes a row: what shares
    a key is dealt by hash to blocks of about ``block`` fingerprints, blocks meet as arrays, and each fingerprint's count
    is summed inside. A key of m fingerprints thus costs (m / block)^2 rows, in as many tasks as its size asks for. Keys of
    a single fingerprint, nearly all of them, end at the count of keys.
    """
    _checked(radius)
    distinct = staged(prints.groupBy("fp0", "fp1").agg(F.sum("n").alias("n")), "distinct")
    rows = _tables(distinct)
    shared = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # Written, so that both sides of the joins are plain exchanges and Spark can split a hot key.
    shared = staged(shared.select("table", "key", F.ceil(F.col("m") / block).alias("blocks")), "shared")
    dealt = F.pmod(F.xxhash64("row.fp0", "row.fp1", F.lit("block")), F.col("blocks"))
    members = rows.join(shared, ["table", "key"]).groupBy("table", "key", dealt.alias("block")).agg(F.collect_list("row").alias("a"))
    members = staged(members, "blocks")
    others = members.select("table", "key", F.col("a").alias("b"))

    def near(x: Column, y: Column) -> Column:
        bits = distance(x["fp0"], x["fp1"], y["fp0"], y["fp1"])
        return (bits <= radius) & (bits > 0) & _meet_first(x, y, F.col("table"))

    count = lambda x: F.aggregate("b", F.lit(0).cast("bigint"), lambda s, y: s + F.when(near(x, y), y["n"]).otherwise(0))
    each = F.transform("a", lambda x: F.struct(x["fp0"].alias("fp0"), x["fp1"].alias("fp1"), count(x).alias("n")))
    met = members.join(others, ["table", "key"]).select(F.filter(each, lambda r: r["n"] > 0).alias("each"))
    more = met.select(F.inline("each")).unionByName(distinct.withColumn("n", F.col("n") - 1))
    return more.groupBy("fp0", "fp1").agg(F.sum("n").alias("near"))


#: A row is known by its id and a hash of its text; none of the three is ever null.
KEY = ["some", "key", "h"]
_NEXT = [f"{c}_next" for c in KEY]


def with_next(docs: DataFrame) -> DataFrame:
    """``KEY``, the key of the next row by id, ``copies``, ``n_chars, text`` and ``beginning``: of each document (``id,
    text``) the first half as many characters of the next one (after the last: the first).

    Null ids come first, and among equal ids the order is that of the hash. Rows that repeat both are one row here, with
    their number in ``copies``. Only keys are sorted; then a text goes to its key, where the one before asks for as much
    of its beginning as it needs.
    """
    keyed = docs.select(
        F.col("id").isNotNull().cast("int").alias("some"), F.coalesce("id", F.lit(0)).alias("key"), F.xxhash64("text").alias("h"), "text"
    )
    slim = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first(F.char_length("text")).cast("bigint").alias("n_chars"))
    placed = global_index(slim, [F.col(c) for c in KEY])
    n = placed.count()
    after = placed.select(F.pmod(F.col("idx") - 1, F.lit(max(n, 1))).alias("idx"), *[F.col(c).alias(x) for c, x in zip(KEY, _NEXT, strict=True)])
    asked = staged(placed.join(after, "idx").drop("idx"), "asked")
    if not asked.where("copies > 1").isEmpty():
        keyed = keyed.groupBy(*KEY).agg(F.first("text").alias("text"))
    half = F.expr("n_chars div 2").cast("int")
    requests = asked.select(*KEY, "n_chars", *_NEXT)
    given = requests.withColumnsRenamed({**{c: f"_{c}" for c in KEY}, **dict(zip(_NEXT, KEY, strict=True))})
    given = keyed.join(given, KEY).select(*[F.col(f"_{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), half).alias("beginning"))
    return keyed.join(asked, KEY).join(given, KEY)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    near_docs``.

    In the edited text the second half is replaced by as much of the next document's beginning. Likeness is the share of
    equal bits; ``near_docs`` counts other documents within ``radius`` bits. A null text is empty; empty texts have
    fingerprint zero. Ids must be integers; null ids come first. Repeated rows are rows of their own, each the next of the
    one before it. Texts of any length count whole; an empty table gives an empty table; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(src)
    kept, half = F.expr("n_chars - n_chars div 2").cast("int"), F.expr("n_chars div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.col("beginning"))
    # What a row becomes whose next one is its own repeat.
    again = F.when(F.col("copies") > 1, F.concat(F.substring("text", F.lit(1), kept), F.substring("text", F.lit(1), half)))
    texts = [F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in enumerate((F.col("text"), edited, again))]
    keys = [*KEY, *_NEXT, "copies", "n_chars"]
    rows = rows.select(*keys, F.inline(F.array(*texts))).where("text is not null")
    # Before the words, or each of them would hash the text.
    rows = rows.withColumn("sha", F.when(F.col("kind") > 0, F.unhex(F.sha2("text", 256))))
    rows = rows.select(*keys, "kind", "sha", F.explode(F.split("text", _WORDS)).alias("word"))
    prints = votes(rows, [*keys, "kind", "sha"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    of = {"fp0": (0, "fp0"), "fp1": (0, "fp1"), "ed0": (1, "fp0"), "ed1": (1, "fp1"), "sha": (1, "sha"), "own0": (2, "fp0"), "own1": (2, "fp1"), "own_sha": (2, "sha")}
    prints = staged(prints.groupBy(*keys).agg(*[pick(*x).alias(c) for c, x in of.items()]), "prints")
    follow = prints.select(*[F.col(c).alias(x) for c, x in zip(KEY, _NEXT, strict=True)], F.col("fp0").alias("next0"), F.col("fp1").alias("next1"))
    near = staged(near_counts(prints.select("fp0", "fp1", F.col("copies").alias("n")), radius), "near")
    out = prints.join(follow, _NEXT).join(near, ["fp0", "fp1"])
    last = F.col("copy") == F.col("copies")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    for c, own in {"ed0": "own0", "ed1": "own1", "sha": "own_sha", "next0": "fp0", "next1": "fp1"}.items():
        out = out.withColumn(c, F.when(last, F.col(c)).otherwise(F.col(own)))
    like = lambda a, b: 1 - distance(F.col("fp0"), F.col("fp1"), F.col(a), F.col(b)) / F.lit(128.0)
    return out.select(
        F.when(F.col("some") == 1, F.col("key")).alias(id_col),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("fp0"), F.col("fp1")).alias("fingerprint"),
        as_text(F.col("ed0"), F.col("ed1")).alias("edited_fingerprint"),
        like("ed0", "ed1").alias("near_edited"),
        like("next0", "next1").alias("near_next"),
        F.col("near").alias("near_docs"),
    )
