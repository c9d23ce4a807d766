"""Line deduplication by deletion neighbourhoods over words.

A line's words (lower-cased, without the white space between them) are its symbols; in scripts
written without spaces each character is one. Two lines are equal within the bound if one word was
inserted, deleted or replaced. Deleting each word of a line in turn gives its variants; two lines
within the bound share a variant that both lose at the same place (replacement), or one is a
variant of the other (insertion). Each variant becomes a hashed key, keys join, and the partner
found is verified word by word.

Only lines that can have a partner emit variants: of two lines within the bound, the first or the
last 2**k words are equal, where 2**k is at most half of the shorter one's words. Per key only the
earliest line matters, so groups are reduced to their minimum, never to pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, sized, stored

#: Default of near_words: lines of fewer words are removed as exact repeats only, as one word in five is the least similarity that the bound of one word allows.
NEAR_WORDS = 5
#: Words whose changes of place are summed together, so that variants of very long lines take few steps each.
BLOCK = 32
#: White space within a line, other than the space itself.
_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana and ideographs.
_ALONE = r"([\x{E01}-\x{EDF}\x{1000}-\x{109F}\x{1780}-\x{17D3}\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}])"
#: Texts of Latin-1 characters alone, white space other than spaces and line ends left out. Single characters, not ranges: a bit table, several times as fast.
_PLAIN = r"\A[" + "".join(f"\\x{k:02x}" for k in range(256) if chr(k) not in _SPACES) + r"]*\z"


def _respaced(text: Column) -> Column:
    low = F.translate(F.lower(text), _SPACES, " " * len(_SPACES))
    return F.when(F.octet_length(text) > F.length(text) + 1, F.regexp_replace(low, _ALONE, " $1 ")).otherwise(low)


def spaced(text: Column) -> Column:
    """A text in lower case, with a space for other white space (but line ends) and around characters that stand alone."""
    # plain texts have neither, and translate looks up every character
    return F.when(F.rlike(text, F.lit(_PLAIN)), F.lower(text)).otherwise(_respaced(text))


def tidy(line: Column) -> Column:
    """A spaced line's words with one space between them."""
    bare = F.trim(line)
    return F.when(F.contains(bare, F.lit("  ")), F.regexp_replace(bare, " +", " ")).otherwise(bare)


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(tidy(spaced(line)), " "), "")


def _half(n: Column) -> Column:
    """The largest power of two that is at most half of n (n >= 2)."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / 2.0) + 1e-9)).cast("int")


def _ends(s: Column, n: Column) -> Column:
    """Keys of the first and last words of a tidy line of n words; those for lines of one word less too where they differ."""
    k, less = _half(n), _half(n - 1)
    part = lambda k: F.call_function("substring_index", s, F.lit(" "), k)
    of = lambda k: F.array(F.xxhash64(F.lit("first"), k, part(k)), F.xxhash64(F.lit("last"), k, part(-k)))
    return F.when(k == less, of(k)).otherwise(F.concat(of(k), of(less)))


def _document(doc_id: str, text: str) -> list[Column]:
    """id and t, a hash of the text; rows that agree in both are one document."""
    return [F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("t")]


def _place() -> Column:
    return F.struct("id", "line", "t")


def _occurrences(documents: DataFrame, doc_id: str, text: str, shortest: int, near_words: int) -> DataFrame:
    """id, t, line, the line's identity (h1, h2) and, of lines of at least near_words words, the keys of its ends."""
    # a select of its own: beside the generator, the text would be hashed for every line
    docs = documents.select(*_document(doc_id, text), spaced(F.col(text)).alias("low"))
    # blank lines go by a filter of their own: one on n would move below and make each line tidy twice
    lines = docs.select("id", "t", F.posexplode(F.split("low", "\n", -1)).alias("line", "raw")).where(F.trim("raw") != "")
    lines = lines.select("id", "t", "line", tidy(F.col("raw")).alias("s"))
    lines = lines.select("id", "t", "line", "s", (F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "))) + 1).alias("n"))
    if shortest > 1:
        lines = lines.where(F.col("n") >= shortest)
    return lines.select("id", "t", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), F.when(F.col("n") >= near_words, _ends(F.col("s"), F.col("n"))).alias("ends"))


def duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 1, near_words: int = NEAR_WORDS) -> DataFrame:
    """id, t (a document's id and the hash of its text) and removed: the numbers, from 0, of its lines that an earlier line equals or is within one word of.

    Earlier means a smaller doc_id (null first), then a smaller line number. The earlier line need
    not be kept itself. Lines of fewer words than near_words (2 at least) go as exact repeats only,
    those of fewer than shortest (at least 1) never: blank lines stay.
    """
    occurrences = stored(_occurrences(documents, doc_id, text, shortest, max(2, near_words)), "lines")
    keys = occurrences.select("h1", F.explode("ends").alias("key"))
    occurrences = occurrences.drop("ends")
    distinct = stored(occurrences.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-lines")

    shared = cut(keys.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("key"))
    partnered = cut(keys.join(sized(shared, 16), "key", "left_semi").select("h1").distinct())
    # pos orders lines as their places do, in one number: ids ascend within and along the sorted partitions
    first = distinct.join(sized(partnered, 16), "h1", "left_semi").select("h1", "h2", "first").sort("first").withColumn("pos", F.monotonically_increasing_id())
    first = cut(first.select("h1", "h2", "pos", "first.*"))
    wanted = cut(first.groupBy("id", "t").agg(F.collect_list(F.struct("line", "pos")).alias("wanted")))
    # null ids meet too: a struct that holds a null is not null
    doc = F.struct("id", "t").alias("doc")
    found = documents.select(F.struct(*_document(doc_id, text)).alias("doc"), F.col(text).alias("text")).join(sized(wanted.select(doc, "wanted"), 64, "wanted", 24), "doc")
    found = found.select("wanted", F.split("text", "\n", -1).alias("lines"))
    found = found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["pos"].alias("pos"), F.get("lines", w["line"]).alias("s")))))
    # rows that repeat a document bring its lines again
    found = found.select("pos", words_of(F.col("s")).alias("words")).dropDuplicates(["pos"])
    held = cut(_mixed(found.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))))

    variants = held.select("pos", F.posexplode(_variants()).alias("i", "v"))
    replaced = variants.groupBy("v", "i").agg(F.min("pos").alias("by"), F.max("pos").alias("latest")).where("by < latest").drop("latest")
    near = variants.join(cut(replaced), ["v", "i"]).where("by < pos").select("pos", "by")
    grown = cut(variants.select("pos", "v").join(held.select(F.col("all").alias("v"), F.col("pos").alias("short")), "v").select("pos", "short"))
    near = near.union(grown.where("short < pos").select("pos", F.col("short").alias("by")))
    near = near.union(grown.groupBy("short").agg(F.min("pos").alias("by")).where("by < short").select("short", "by"))
    pairs = near.distinct().join(held.select("pos", "words"), "pos").join(held.select(F.col("pos").alias("by"), F.col("words").alias("other")), "by")
    late = pairs.where(within_one(F.col("words"), F.col("other"))).select("pos").distinct()
    late = cut(first.join(late, "pos", "left_semi").select("h1", "h2"))

    doubtful = distinct.join(sized(late, 24).withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("copies > 1 or near")
    doubtful = doubtful.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # doubtful and removed lines grow with the corpus: both are shuffled at every size
    gone = occurrences.join(doubtful, ["h1", "h2"]).where(F.col("near") | (_place() != F.col("first")))
    return gone.groupBy("id", "t").agg(F.collect_list("line").alias("removed"))


def _xor(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _mixed(lines: DataFrame) -> DataFrame:
    """lines (with word hashes h) and what makes each variant's key in a few steps.

    A line's key is the exclusive or of its words' hashes mixed with their places (all). Without
    word i, words before i keep their places and those after it move down by one: `moved` has each
    word's hash at the place below, `turn` what such a move changes, `upto` the changes of all
    earlier blocks of BLOCK words.
    """
    lines = lines.withColumns({"at": F.transform("h", lambda w, j: F.xxhash64(w, j)), "moved": F.transform("h", lambda w, j: F.xxhash64(w, j - 1))})
    lines = lines.withColumns({"all": _xor(F.col("at")), "below": _xor(F.col("moved")), "turn": F.zip_with("at", "moved", lambda a, b: a.bitwiseXOR(b))})
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("turn") / BLOCK).cast("int")), lambda k: _xor(F.slice("turn", k * BLOCK + 1, BLOCK)))
    lines = lines.withColumn("blocks", blocks).withColumn("upto", F.transform("blocks", lambda _, k: _xor(F.slice("blocks", F.lit(1), k))))
    return lines.drop("h", "at", "blocks")


def _variants() -> Column:
    """The key of the line without each of its words in turn."""

    def without(moved: Column, i: Column) -> Column:
        k = F.floor(i / BLOCK).cast("int")
        earlier = F.get("upto", k).bitwiseXOR(_xor(F.slice("turn", k * BLOCK + 1, i - k * BLOCK)))
        return F.col("below").bitwiseXOR(moved).bitwiseXOR(earlier)

    return F.transform("moved", without)


def within_one(x: Column, y: Column) -> Column:
    """Whether two arrays of words differ by at most one insertion, deletion or replacement."""
    short = F.least(F.size(x), F.size(y))
    same = F.aggregate(
        F.zip_with(F.slice(x, 1, short), F.slice(y, 1, short), lambda a, b: a == b),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["k"] + (s["on"] & e).cast("int")).alias("k"), (s["on"] & e).alias("on")),
        lambda s: s["k"],
    )
    rest = lambda z, skip: F.slice(z, same + 1 + skip, F.size(z))
    return (
        ((F.size(x) == F.size(y)) & (rest(x, 1) == rest(y, 1)))
        | ((F.size(x) + 1 == F.size(y)) & (rest(x, 0) == rest(y, 1)))
        | ((F.size(x) == F.size(y) + 1) & (rest(x, 1) == rest(y, 0)))
    )


def _kept(documents: DataFrame, doc_id: str, text: str, shortest: int, near_words: int) -> DataFrame:
    """row (a document's columns), lines, removed (null without any) and thinned (the text of the other lines)."""
    removed = duplicates(documents, doc_id, text, shortest, near_words).select(F.struct("id", "t").alias("doc"), "removed")
    rows = documents.select(F.struct("*").alias("row"), F.struct(*_document(doc_id, text)).alias("doc"))
    others = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    thinned = F.when(F.col("removed").isNull(), F.col("row")[text]).otherwise(F.array_join(F.transform(others, lambda i: F.get("lines", i)), "\n"))
    # split after the join, which would else move each text twice
    joined = rows.join(removed, "doc", "left").withColumn("lines", F.split(F.col("row")[text], "\n", -1))
    return joined.select("row", "lines", "removed", thinned.alias("thinned"))


def _columns(documents: DataFrame, text: str) -> list[Column]:
    return [F.col("thinned").alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns]


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 1, near_words: int = NEAR_WORDS) -> DataFrame:
    """documents without repeated lines, and with n_lines and n_removed after their columns (columns of these names are replaced).

    A null text stays null with no lines; an empty one has one empty line. Blank lines stay, and
    lines of fewer than shortest words. Rows that agree in id and text are one document and keep the
    same lines; rows that share only the id are apart, null ids too. Other columns pass unchanged;
    an empty table gives none.
    """
    base = documents.drop("n_lines", "n_removed")
    n_lines = F.when(F.col("row")[text].isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines")
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed")
    return _kept(base, doc_id, text, shortest, near_words).select(*_columns(base, text), n_lines, n_removed)


def thin(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 1, near_words: int = NEAR_WORDS) -> DataFrame:
    """documents without repeated lines; those that lost lines and have only white space left go.

    Null and empty texts lose nothing and stay. Rows that repeat an id and a text lose the same
    lines, so that none is left out for being a copy of itself. Other columns pass unchanged,
    whatever their names; an empty table gives none.
    """
    emptied = F.col("removed").isNotNull() & (F.trim(F.translate("thinned", "\n" + _SPACES, " " * (1 + len(_SPACES)))) == "")
    return _kept(documents, doc_id, text, shortest, near_words).where(~emptied).select(*_columns(documents, text))
