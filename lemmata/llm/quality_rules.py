"""Quality rules under weak supervision.

Every rule has an opinion, *good* or *bad*, which it votes or abstains from.
Expectation-maximisation over the counts of vote patterns estimates how often
each rule's votes are right, and the posterior
probability of *good* given a document's votes decides, in place of the usual
demand that all rules pass.

All work on rows is DataFrame expressions; the driver sees one row for each
distinct vote pattern, of which there are at most ``2 ** len(rules())``.

Defined results: a null or empty text has no words and fails the base rules;
columns other than ``doc_id`` and ``text`` are ignored; repeated rows each get
their own (equal) result; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS, SHOUTS, STOPS, MARKS = "#*$%&|<>", "!?", ".,;:", "*#$%&<>|!"
GOOD, ABSTAIN, BAD = 1, 0, -1
#: Bytes above which a text is taken apart over many rows, and characters of a piece of it.
LONG, PIECE = 1 << 20, 1 << 18
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_shouts", "n_upper", "n_stops", "n_marked")


def _signs(text: Column) -> dict[str, Column]:
    """Counts of single characters. One pass leaves only what any of them counts."""
    left = F.regexp_replace(text, rf"[^{SYMBOLS}{SHOUTS}{STOPS}A-Z]+", "")
    kinds = {"n_symbols": SYMBOLS, "n_shouts": SHOUTS, "n_upper": "A-Z", "n_stops": STOPS}
    return {k: F.length(F.regexp_replace(left, f"[^{chars}]+", "")).cast("long") for k, chars in kinds.items()}


def _in_arrays(rows: DataFrame) -> DataFrame:
    """``rows`` without ``text`` but with its statistics, by arrays of one text's words.

    Windows are compared by a 64-bit hash of their three words. Where some are
    equal they are sorted with their places, places of windows equal to a
    neighbour are kept in text order, and each adds the words that the place
    before it did not cover. Every array that a lambda reads is a column that
    is read twice at least, as the optimizer would move one that is read once
    into the lambda and make it anew for each element."""
    keep = [c for c in rows.columns if c != "text"]
    text = F.col("text")
    step = rows.select(*keep, F.array_remove(F.split(text, f"{SPACE}+"), "").alias("_w"), F.split(text, "\n").alias("_l"), *(c.alias(k) for k, c in _signs(text).items()), F.regexp_count(text, F.lit(rf"[{MARKS}](?!{_negated(SPACE)})")).cast("long").alias("n_marked"))
    keep += ["n_symbols", "n_shouts", "n_upper", "n_stops", "n_marked"]
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    step = step.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.when(F.size("_w") > 3, windows).alias("_h"),
        F.filter("_l", lambda x: x.rlike(_negated(SPACE))).alias("_l"),
    )
    keep += ["n_words", "word_chars", "n_distinct_words"]
    lines = F.size("_l").cast("long")
    numbered = F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))
    step = step.select(*keep, lines.alias("n_lines"), (lines - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), F.when(F.size(F.array_distinct("_h")) < F.size("_h"), numbered).alias("_p"))
    keep += ["n_lines", "n_dup_lines"]
    same = lambda x, i: F.get("_p", i)["h"] == x["h"]
    places = F.filter(F.transform("_p", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda p: p.isNotNull())
    step = step.select(*keep, F.sort_array(places).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    return step.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _negated(chars: str) -> str:
    return f"[^{chars[1:]}"


def _parted(pieces: DataFrame, at: str) -> DataFrame:
    """(_row, slot, part): the texts split at the pattern ``at``. The last part
    of a piece and the first one of the next have one slot and are put together."""
    parts = pieces.select("_row", "_piece", F.split("_t", at).alias("_x"))
    before = F.sum(F.size("_x") - 1).over(Window.partitionBy("_row").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_base", F.coalesce(before, F.lit(0)))
    parts = parts.select("_row", "_piece", "_base", F.posexplode("_x").alias("_i", "_x")).select("_row", (F.col("_base") + F.col("_i")).alias("slot"), "_piece", "_x")
    ordered = F.array_sort(F.collect_list(F.struct("_piece", "_x")))
    return parts.groupBy("_row", "slot").agg(F.array_join(ordered["_x"], "").alias("part"))


def _in_rows(rows: DataFrame) -> DataFrame:
    """As ``_in_arrays``, with a row for each piece, word and line of a text, so
    that no task holds more of it than its pieces. ``_row`` names the text."""
    keep = [c for c in rows.columns if c not in ("text", "_row")]
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE).cast("int"))
    pieces = written(rows.select("_row", F.col("text").alias("_t"), F.explode(numbers).alias("_piece")).select("_row", "_piece", F.substring("_t", F.col("_piece") * PIECE + 1, F.lit(PIECE)).alias("_t")), "pieces", 10)
    signs = pieces.select("_row", *(c.alias(k) for k, c in _signs(F.col("_t")).items())).groupBy("_row").agg(*(F.sum(k).alias(k) for k in ("n_symbols", "n_shouts", "n_upper", "n_stops")))
    words = written(_parted(pieces, SPACE).where("part <> ''"), "words")
    order = Window.partitionBy("_row").orderBy("slot")
    counted = words.groupBy("_row").agg(
        F.count("*").alias("n_words"),
        F.sum(F.length("part")).alias("word_chars"),
        F.count_if(F.col("part").rlike(f"[{MARKS}]$")).alias("n_marked"),
    )
    distinct = words.groupBy("_row", "part").agg(F.lit(1).alias("one")).groupBy("_row").agg(F.count("*").alias("n_distinct_words"))
    three = written(words.select("_row", F.row_number().over(order).alias("at"), F.col("part").alias("a"), F.lead("part").over(order).alias("b"), F.lead("part", 2).over(order).alias("c")).where("c is not null"), "windows")
    often = three.groupBy("_row", "a", "b", "c").count().where("count > 1").drop("count")
    place = three.join(often, ["_row", "a", "b", "c"]).select("_row", "at")
    new = F.least(F.lit(3), F.coalesce(F.col("at") - F.lag("at").over(Window.partitionBy("_row").orderBy("at")), F.lit(3)))
    repeats = place.select("_row", new.alias("new")).groupBy("_row").agg(F.sum("new").alias("n_repeat_words"))
    lines = _parted(pieces, "\n").where(F.col("part").rlike(_negated(SPACE))).groupBy("_row", "part").agg(F.count("*").alias("n"))
    lines = lines.groupBy("_row").agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") - 1).alias("n_dup_lines"))
    out = rows.select("_row", *keep)
    for part in (signs, counted, distinct, repeats, lines):
        out = out.join(part, "_row", "left")
    return out.select(*keep, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in STATISTICS))


def with_statistics(docs: DataFrame, long: int = LONG) -> DataFrame:
    """``doc_id`` and the statistics that the rules read, over whole texts, as a
    written table. A text of more than ``long`` bytes, which arrays of its words
    would make many times as large, is taken apart over rows; both ways give the
    same."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    is_long = F.octet_length("text") > long
    short = rows.select("doc_id", is_long.alias("_long"), F.when(~is_long, F.col("text")).otherwise("").alias("text"))
    done = written(_in_arrays(short), "statistics")
    out = done.where("not _long").select("doc_id", *STATISTICS)
    if done.where("_long").isEmpty():
        return out
    apart = written(rows.where(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts", 10)
    return out.union(written(_in_rows(apart).select("doc_id", *STATISTICS), "long-statistics"))


#: How often a rule with that opinion is first believed to vote on good and on
#: bad documents: tests for junk fire seldom on good text, signs of prose often.
FIRST_RATES = {BAD: (0.02, 0.3), GOOD: (0.9, 0.6)}


def rules() -> dict[str, tuple[int, Column]]:
    """Each rule's one opinion and when it holds; otherwise it abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": (BAD, words < 20),
        "odd_words": (BAD, (chars < 2 * words) | (chars > 15 * words)),
        "symbols": (BAD, 10 * F.col("n_symbols") > words),
        "dup_lines": (BAD, 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        "repeats": (BAD, 100 * F.col("n_repeat_words") > 45 * words),
        "capitals": (BAD, 10 * F.col("n_upper") > 4 * chars),
        "shouting": (BAD, 10 * F.col("n_shouts") > 2 * words),
        "marked_words": (BAD, 10 * F.col("n_marked") > 2 * words),
        "plain_words": (GOOD, (chars >= 3 * words) & (chars <= 10 * words)),
        "varied": (GOOD, 100 * F.col("n_distinct_words") >= 35 * words),
        "sentences": (GOOD, (F.col("n_stops") * 100 >= words * 3) & (10 * F.col("n_upper") < 2 * chars)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], opinions: list[int], rounds: int = 30, prior: float = 0.8):
    """Expectation-maximisation on (votes, number of documents). Returns the
    share of good documents and, for each rule, how often it votes on good and
    on bad ones; a rule's accuracy follows from these three.

    Every estimate is drawn towards ``FIRST_RATES`` and ``prior`` with the
    weight of a fiftieth of all documents, and a rule's rates are never
    reversed against its opinion: it can become worthless, but which of the
    two classes is called good stays pinned."""
    rates, share = [FIRST_RATES[o] for o in opinions], prior
    total = sum(n for _, n in patterns)
    pull = total / 50
    for _ in range(rounds if total else 0):
        good, fired = 0.0, [[0.0, 0.0] for _ in opinions]
        for pattern, n in patterns:
            p = posterior(pattern, rates, share)
            good += n * p
            for r, v in enumerate(pattern):
                if v != ABSTAIN:
                    fired[r][0] += n * p
                    fired[r][1] += n * (1 - p)
        share = (good + pull * prior) / (total + pull)
        rates = [_rate(o, *((k + pull * q) / (m + pull) for k, q, m in zip(f, FIRST_RATES[o], (good, total - good), strict=True))) for f, o in zip(fired, opinions, strict=True)]
    return share, rates


def _rate(opinion: int, on_good: float, on_bad: float) -> tuple[float, float]:
    if opinion * (on_good - on_bad) < 0:
        on_good = on_bad = (on_good + on_bad) / 2
    return tuple(min(0.999, max(0.001, x)) for x in (on_good, on_bad))


def accuracy(opinion: int, rate: tuple[float, float], share: float) -> float:
    """Probability that a vote of the rule is right."""
    good, bad = rate[0] * share, rate[1] * (1 - share)
    return (good if opinion == GOOD else bad) / (good + bad)


def weights(rate: tuple[float, float]) -> tuple[float, float]:
    """What a vote and an abstention add to the log-odds of good."""
    return math.log(rate[0] / rate[1]), math.log((1 - rate[0]) / (1 - rate[1]))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def posterior(pattern, rates, share: float) -> float:
    return 1 / (1 + math.exp(-logit(share) - sum(weights(r)[v == ABSTAIN] for v, r in zip(pattern, rates, strict=True))))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statistics, each rule's vote ``vote_<rule>``, ``base_failed``, the
    ``posterior`` of good and ``kept`` for every row of ``docs``."""
    named = rules()
    stats = with_statistics(docs)
    columns = [f"vote_{k}" for k in named]
    votes = stats.select("*", *(F.when(when, F.lit(o)).otherwise(F.lit(ABSTAIN)).alias(c) for c, (o, when) in zip(columns, named.values(), strict=True)))
    counted = votes.groupBy(*columns).count().collect()  # 2 ** 11 rows at most
    share, rates = fit([(tuple(r[c] for c in columns), r["count"]) for r in counted], [o for o, _ in named.values()])
    score = F.lit(logit(share))
    for c, r in zip(columns, rates, strict=True):
        vote, abstention = weights(r)
        score = score + F.when(F.col(c) != ABSTAIN, F.lit(vote)).otherwise(F.lit(abstention))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        votes.withColumn("posterior", 1 / (1 + F.exp(-score)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
