"""Quality rules with verdicts on hosts, by DataFrame functions only.

Every document is measured by itself (words, symbols, repeated lines, words in repeated
8-word windows) and fails or passes the base rules. Failures are then summed by host; each
host's failure rate is shrunk towards the whole table's by a beta prior whose mean and
strength come from the hosts' own rates (method of moments). A host is blocked if its rate
is surely far above the table's: if the shrunk rate less SURE posterior deviations is over
FAR times the prior's mean. Verdicts are joined back: a blocked host's documents are not kept.

Windows are found by 64-bit hashes within one text and compared word by word where hashes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30
SURE, FAR = 3, 2
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once (as the variable of a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(tokens: Column) -> Column:
    """Words inside 8-word windows that occur twice or more among tokens."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def twins(placed: Column) -> Column:
        """Those that share their h with a neighbour."""
        n = F.size(placed)

        def twin(e: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(placed, i - 1)["h"] == e["h"]).otherwise(False)
            return before | F.when(i + 1 < n, F.get(placed, i + 1)["h"] == e["h"]).otherwise(False)

        return F.filter(placed, twin)

    def among(placed: Column) -> Column:
        """placed: (hash, position), sorted; how many words the repeated windows cover."""
        # the few windows whose hashes meet, by their words
        same = F.transform(twins(placed), lambda e: F.struct(F.array_join(F.slice(tokens, e["at"] + 1, WINDOW), " ").alias("h"), e["at"].alias("at")))
        return let(F.array_sort(same), covered)

    def covered(placed: Column) -> Column:
        starts = F.array_sort(F.transform(twins(placed), lambda e: e["at"]))
        zero = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda s, at: F.struct((s["sum"] + F.least(F.lit(WINDOW), at - s["last"])).alias("sum"), at.alias("last")), lambda s: s["sum"])

    def count(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(placed, among))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < WINDOW + 1, F.lit(0)).otherwise(let(let(hashes, windows), count))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures and ``base_failed``; a null text has no words.

    Columns that carry a measure's name give way.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def lines(t: Column) -> Column:
        with_word = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
        return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("n"), F.length(F.array_join(tokens, "")).alias("chars"), repeated_words(tokens).alias("repeat"))

    found = fresh(docs, *MEASURES, "_of").withColumn("_of", let(words(whole), of))
    found = found.withColumns(
        {
            "n_words": F.col("_of.n").cast("long"),
            "word_chars": F.col("_of.chars").cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": lines(whole).cast("long"),
            "n_repeat_words": F.col("_of.repeat").cast("long"),
        }
    ).drop("_of")
    return found.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """(host, n, failed, rate, shrunk, bound, blocked), a row per host (null is a host like others).

    Prior: mean m = failed/n over all rows; v = the hosts' mean squared distance from m,
    weighted by their rows, less the m(1-m)*hosts/rows that chance alone gives (at least 1e-6);
    strength s = m(1-m)/v - 1, between 1 and 10^6. Shrunk rate p: (failed + s*m) / (n + s), the
    posterior's mean; its deviation: sqrt(p(1-p)/(n+s+1)); bound: p less SURE deviations.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = hosts.withColumn("rate", F.col("failed") / F.col("n"))
    sums = hosts.agg(F.sum("n").alias("rows"), F.sum("failed").alias("all_failed"), F.count("*").alias("hosts"), F.sum(F.col("failed") * F.col("rate")).alias("squares"))
    m = F.col("all_failed") / F.col("rows")
    chance = m * (1 - m) * F.col("hosts") / F.col("rows")
    spread = F.greatest(F.lit(1e-6), F.col("squares") / F.col("rows") - m * m - chance)
    prior = sums.filter("rows > 0").select(m.alias("m"), F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / spread - 1)).alias("s"))
    # the prior is one row
    shrunk = hosts.join(F.broadcast(prior)).withColumn("shrunk", (F.col("failed") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s")))
    bound = F.col("shrunk") - SURE * F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (F.col("n") + F.col("s") + 1))
    return shrunk.withColumn("bound", bound).select("host", "n", "failed", "rate", "shrunk", "bound", (F.col("bound") > FAR * F.col("m")).alias("blocked"))


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs without their text, with the measures, ``host_rate`` (shrunk), ``host_bound`` (its lower
    bound) and ``kept``: passed, on a host that isn't blocked.

    The measures (a few numbers a document) are written to the shared folder, so texts are
    read once. Hosts are as many as there are; the join is left to Spark, which broadcasts
    verdicts only while they are small and splits a hot host otherwise.

    A null text has no words and fails the base rules; texts of any length are measured whole.
    Repeated rows count each time and stay repeated. Documents without a host are judged as
    one host. An empty table gives no rows. Columns named as results give way.
    """
    measured = stored(measure(fresh(docs, "kept", "host_rate", "host_bound"), text).drop(text), "measured")
    verdicts = host_verdicts(measured, host).select("host", F.col("shrunk").alias("host_rate"), F.col("bound").alias("host_bound"), "blocked")
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("blocked", F.lit(False))).drop("host", "blocked")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", *MEASURES, "kept", F.round("host_rate", 6).alias("host_rate"), F.round("host_bound", 6).alias("host_bound"))


SQL = """
with words as (
  select doc_id, source, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i+7], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)
), twice as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1
), covered as (
  select doc_id, sum(least(8, i - coalesce(prev, i - 8))) as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from twice) group by doc_id
), lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from words
), base as (
  select words.doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from words join lines using (doc_id) left join covered using (doc_id)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
), hosts as (
  select source as host, count(*)::double as n, sum(base_failed::int)::double as failed from judged group by source
), prior as (
  select m, least(1e6, greatest(1.0, m * (1 - m) / greatest(1e-6, squares / total - m * m - m * (1 - m) * hosts / total) - 1)) as s
  from (select sum(failed) / sum(n) as m, sum(n) as total, count(*) as hosts, sum(failed * failed / n) as squares from hosts)
), shrunk as (
  select host, n, s, m, (failed + s * m) / (n + s) as rate from hosts, prior
), verdicts as (
  select host, rate, rate - 3 * sqrt(rate * (1 - rate) / (n + s + 1)) as bound, rate - 3 * sqrt(rate * (1 - rate) / (n + s + 1)) > 2 * m as blocked from shrunk
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not blocked as kept,
  round(rate, 6) as host_rate, round(bound, 6) as host_bound
from judged join verdicts on source is not distinct from host
"""

QUERIES = {"op2_host_rules": query}
ORACLES = {"op2_host_rules": SQL}
