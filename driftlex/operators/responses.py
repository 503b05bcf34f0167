"""Model responses: de-duplication, parsing, token log-probabilities, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First words that read as yes and as no.
YES = "yes|yeah|yep|yup|sure|absolutely|definitely|totally|true|appropriate|ok|okay|current|contemporary"
NO = "no|nope|nah|never|not|inappropriate|false|dated|anachronistic|archaic|early"
# Words that read as yes and as no anywhere, and those that keep a yes from counting.
YES_ANYWHERE, NO_ANYWHERE, DENIAL_ANYWHERE = r"\byes\b|\bappropriate\b", r"\bno\b|\bnot\b|\binappropriate\b", r"\bnot\b|\binappropriate\b"
# The option block of a prompt, one option of it, a chosen letter, a bare letter.
OPTION_BLOCK = r"(?is)multiple choice:\s*(.*)$"
OPTION = r"(?s)\b([ABCD])\)\s*(.*?)(?=\s+\b[ABCD]\)|$)"
LETTER = r"^[^\p{L}\p{N}_]*([ABCD])(?![\p{L}\p{N}_])"
LONE_LETTER = r"(?<![\p{L}\p{N}_])([ABCD])(?![\p{L}\p{N}_])"
BARE_LETTER = r"^[ABCD][).]?$"
# A slot whose word its name can't spell; the years that answers are drawn in.
SLOT_WORDS = {"exp3_skull": "💀"}
FIRST_YEAR, LAST_YEAR = 2010, 2024


def canonical(variables: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(variables))))


def newest_of_files(rows: DataFrame, keys: list[str], name: str = "file", modified: str = "modified", index: str = "index") -> DataFrame:
    """Of each key the record of the newest file, the last one there; ``index`` is a record's place in its file."""
    age = file_order(F.col(name), F.unix_timestamp(modified))
    return latest(rows, keys, age, F.col(name), F.col(index))


def latest(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """Of each key the newest record."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in newest])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def file_order(name: Column, modified: Column) -> Column:
    """Sortable age of a response file: its run stamp, else ``m`` and its time, which comes after all stamps."""
    stamp = F.regexp_replace(F.regexp_extract(name, r"_(\d{8}_\d{6})(?:\.jsonl)?$", 1), "_", "")
    return F.when(stamp != "", stamp).otherwise(F.concat(F.lit("m"), F.lpad(modified.cast("string"), 20, "0")))


# --- answers in free text -------------------------------------------------


def yes_no(response: Column) -> Column:
    """1 yes, 0 no, null unclear: by the first words, else by a word anywhere, the rules in order."""
    t = F.regexp_replace(F.lower(F.btrim(response)), "^[^a-z]+", "")
    out = None
    for verdict, has, lacks in ((1, rf"^({YES})\b", None), (0, rf"^({NO})\b", None), (1, YES_ANYWHERE, DENIAL_ANYWHERE), (0, NO_ANYWHERE, None)):
        met = t.rlike(has) if lacks is None else t.rlike(has) & ~t.rlike(lacks)
        out = F.when(met, verdict) if out is None else out.when(met, verdict)
    return out


def year_in(response: Column) -> Column:
    """First four-digit year from 1000 to 2099 with no digit beside it."""
    return F.nullif(F.regexp_extract(response, r"(?<!\d)(1\d{3}|20\d{2})(?!\d)", 1), F.lit("")).cast("int")


def clamped(year: Column, low: int = FIRST_YEAR, high: int = LAST_YEAR) -> Column:
    return F.least(F.greatest(year, F.lit(low)), F.lit(high))


def options(prompt: Column) -> Column:
    """Letters and words of a multiple-choice prompt, as a map; empty if there is no option block."""
    tail = F.regexp_extract(prompt, OPTION_BLOCK, 1)
    letters, words = F.regexp_extract_all(tail, F.lit(OPTION), F.lit(1)), F.regexp_extract_all(tail, F.lit(OPTION), F.lit(2))
    pairs = F.zip_with(letters, words, lambda a, b: F.struct(a.alias("key"), F.btrim(b).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def answer(response: Column) -> Column:
    """(letter, status) of a forced choice: clean, lenient, enumeration, unparsed or empty."""
    ws = F.lit(" \t\r\n\x0b\x0c")
    s = F.btrim(F.btrim(F.btrim(F.coalesce(response, F.lit("")), ws), F.lit("*")), ws)
    several = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(LONE_LETTER), F.lit(1)))) >= 3
    first = F.regexp_extract(s, LETTER, 1)
    status = F.when(s == "", "empty").when(several, "enumeration").when(first == "", "unparsed").when(s.rlike(BARE_LETTER), "clean").otherwise("lenient")
    return F.struct(F.when(status.isin("clean", "lenient"), first).alias("letter"), status.alias("status"))


def choice(response: Column, opts: Column, target: Column) -> Column:
    """(letter, status) of a forced choice with its options: ``no_options`` without any or without the target's letter."""
    a = answer(response)
    lost = (F.coalesce(F.size(opts), F.lit(0)) <= 0) | target.isNull()
    return F.struct(F.when(~lost, a["letter"]).alias("letter"), F.when(lost, "no_options").otherwise(a["status"]).alias("status"))


def normal_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(word)), r"[\s_-]+", " ")


def target_letter(slot: Column, opts: Column, overrides: dict[str, str] | None = None) -> Column:
    """Letter of the option that is the slot's own word."""
    want = F.regexp_replace(slot, "^exp3_", "")
    for k, v in (overrides or SLOT_WORDS).items():
        want = F.when(slot == k, v).otherwise(want)
    want = normal_word(want)
    return F.try_element_at(F.map_keys(F.map_filter(opts, lambda k, v: normal_word(v) == want)), F.lit(1))


def slot_of(word: Column) -> Column:
    return F.concat(F.lit("exp3_"), F.regexp_replace(word, "[ -]", "_"))


def word_of(response: Column, joined: Column) -> Column:
    """One-word answer: the response, or else joined answer tokens; quotes and stops stripped, lower case."""
    trim = lambda c: F.lower(F.btrim(F.btrim(c), F.lit("\"'.")))
    return F.when(F.coalesce(response, F.lit("")) != "", trim(response)).otherwise(trim(joined))


def labelled_examples(response: Column) -> Column:
    """Texts and labels of the object in a free text: array of (text, is_slang), of those that have a text and a label 0 or 1.

    A label may be a number, a string of one or a boolean; null if there is no such object.
    """
    found = json_rows(response, "examples array<struct<text: string, is_slang: string>>")["examples"]
    label = lambda x: F.when(x == "true", 1).when(x == "false", 0).otherwise(F.btrim(x).try_cast("double").cast("int"))
    rows = F.transform(found, lambda e: F.struct(F.btrim(e["text"], F.lit(" \t\r\n\x0b\x0c")).alias("text"), label(e["is_slang"]).alias("is_slang")))
    return F.filter(rows, lambda e: (F.coalesce(e["text"], F.lit("")) != "") & e["is_slang"].isin(0, 1))


def json_rows(response: Column, schema: str) -> Column:
    """What is between the outermost braces of a free text, parsed; null if it is no such object."""
    return F.from_json(F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit("")), schema)


# --- token log-probabilities ----------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and deep the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last(entries: Column) -> Column:
    """(key, value) entries, of equal keys the last."""
    return _let(entries, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e), F.lit(1))), lambda y: y["key"] == x["key"])))


def _last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries; null keys are left out, null entries give an empty map."""
    e = F.filter(F.coalesce(entries, F.array().cast("array<struct<key:string,value:double>>")), lambda x: x["key"].isNotNull())
    return F.map_from_entries(_last(e))


def tokens_of(content: Column, tokens: Column, logprobs: Column, tops: Column) -> Column:
    """Both payload layouts as array<struct<token, logprob, top map>>; a null log-probability is 0, of equal top tokens the last counts."""
    top = lambda c: _last_of_each(F.transform(c["top_logprobs"], lambda a: F.struct(a["token"].alias("key"), a["logprob"].cast("double").alias("value"))))
    one = F.transform(content, lambda c: F.struct(c["token"].alias("token"), c["logprob"].cast("double").alias("logprob"), top(c).alias("top")))
    none = F.create_map().cast("map<string,double>")
    two = _let(
        F.struct(logprobs.alias("p"), tops.alias("t")),
        lambda s: F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.coalesce(F.get(s["p"], i), F.lit(0.0)).cast("double").alias("logprob"), F.coalesce(F.get(s["t"], i), none).alias("top"))),
    )
    return F.when(F.size(content) > 0, one).otherwise(two)


def without_routing(tokens: Column) -> Column:
    """Leading ``<|...`` tokens dropped, each with the plain token after it."""
    # 0: at a marker or the answer; 1: after a marker; 2: in the answer
    step = lambda a, t: F.when(a["s"] == 2, a).otherwise(
        F.when(t["token"].startswith("<|"), F.struct(F.lit(1).alias("s"), (a["n"] + 1).alias("n")))
        .when(a["s"] == 1, F.struct(F.lit(0).alias("s"), (a["n"] + 1).alias("n")))
        .otherwise(F.struct(F.lit(2).alias("s"), a["n"].alias("n")))
    )
    start = F.aggregate(tokens, F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), step, lambda a: a["n"])
    return F.slice(tokens, start + 1, F.size(tokens))


def answer_length(tokens: Column) -> Column:
    """Leading tokens of the answer: up to a special token, a stop sign, or a blank one once there is a word."""
    step = lambda a, t: F.when(
        a["stop"] | t["token"].startswith("<") | t["token"].rlike(r"[.!?,\n]") | ((F.btrim(t["token"]) == "") & (a["n"] > 0)),
        F.struct(F.lit(True).alias("stop"), a["n"].alias("n")),
    ).otherwise(F.struct(F.lit(False).alias("stop"), (a["n"] + 1).alias("n")))
    return F.aggregate(tokens, F.struct(F.lit(False).alias("stop"), F.lit(0).alias("n")), step, lambda a: a["n"])


def strict_answer_length(tokens: Column) -> Column:
    """The other rule: any token with white space or a stop sign ends the answer."""
    step = lambda a, t: F.when(a["stop"] | t["token"].rlike(r"[\s.!?,]"), F.struct(F.lit(True).alias("stop"), a["n"].alias("n"))).otherwise(F.struct(F.lit(False).alias("stop"), (a["n"] + 1).alias("n")))
    return F.aggregate(tokens, F.struct(F.lit(False).alias("stop"), F.lit(0).alias("n")), step, lambda a: a["n"])


def joined_tokens(tokens: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(tokens, F.lit(1), n), lambda t: t["token"]), "")


def joint_logprob(tokens: Column, n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.slice(tokens, F.lit(1), n), F.lit(0.0), lambda a, t: a + t["logprob"]))


def first_distribution(tokens: Column) -> Column:
    """Normalised probabilities of the first position's candidates, trimmed and lower case; of equal ones the last counts."""
    e = F.map_entries(F.coalesce(F.get(tokens, F.lit(0))["top"], F.create_map().cast("map<string,double>")))
    e = F.filter(e, lambda x: F.btrim(x["key"]) != "")
    e = F.transform(e, lambda x: F.struct(F.lower(F.btrim(x["key"])).alias("key"), F.exp(x["value"]).alias("value")))
    share = lambda s: F.transform(s["e"], lambda x: F.struct(x["key"], F.when(s["total"] > 0, x["value"] / s["total"]).otherwise(x["value"])))
    summed = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))
    return F.map_from_entries(_let(_let(_last(e), summed), share))


def combined_probability(tokens: Column, response: Column) -> Column:
    """Probability of the first token span that spells the response, blanks and case aside; else of all tokens.

    Tokens are flattened and joined once: a span fits where the joined text goes on with the response and a
    token ends where that ends.
    """
    blanks = F.lit(" \t\r\n\x0b\x0c")
    flat = F.transform(tokens, lambda t: F.lower(F.btrim(t["token"], blanks)))
    want = F.lower(F.replace(F.btrim(response, blanks), F.lit(" "), F.lit("")))
    ends = lambda f: F.aggregate(f, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    made = lambda f: F.struct(F.array_join(f, "").alias("whole"), ends(f).alias("ends"), want.alias("want"))

    def span(s: Column) -> Column:
        # ends[i] is where token i begins; the first end from there on that closes the response
        begin = lambda i: F.get(s["ends"], i)
        close = lambda i: F.array_position(F.slice(s["ends"], i + 2, F.size(s["ends"])), begin(i) + F.length(s["want"])).cast("int")
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s["ends"]) - 2, F.lit(0))), lambda i: F.coalesce(F.substring(s["whole"], begin(i) + 1, F.length(s["want"])) == s["want"], F.lit(False)))
        fits = F.filter(F.transform(starts, lambda i: F.struct(i.alias("a"), close(i).alias("k"))), lambda x: x["k"] > 0)
        return F.coalesce(F.get(fits, F.lit(0)), F.struct(F.lit(0).alias("a"), F.size(tokens).alias("k")))

    found = _let(_let(flat, made), span)
    part = _let(found, lambda x: F.slice(tokens, x["a"] + 1, x["k"]))
    return F.when(F.size(tokens) > 0, F.exp(F.aggregate(part, F.lit(0.0), lambda x, t: x + t["logprob"])))


def with_text_response(records: DataFrame, texts: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Log-probability records with ``response``, trimmed, of the first text record with the same keys, by ``order``; null without one.

    Keys match null with null. Of a key's text records only the first travels on.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = texts.where(F.col("response").isNotNull()).withColumn("__r", rank).where("__r = 1")
    first = first.select(*[F.col(k).alias(f"__{k}") for k in keys], F.btrim("response", F.lit(" \t\r\n\x0b\x0c")).alias("response"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return records.drop("response").join(first, same, "left").drop(*[f"__{k}" for k in keys])


# --- aggregates -----------------------------------------------------------


def target_rate(rows: DataFrame, *by: str) -> DataFrame:
    """Share of answers that choose the target, of parsed ones."""
    return rows.where("letter is not null").groupBy(*by).agg(F.avg(F.col("is_target").cast("double")).alias("target_rate"), F.count("*").alias("n"))


def distractors(rows: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The n commonest wrong choices."""
    c = rows.where("letter is not null and not is_target").groupBy(*by, "choice").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "choice"))).where(F.col("rank") <= n)


def tidy_choices(rows: DataFrame, by: list[str]) -> DataFrame:
    c = rows.where("letter is not null").groupBy(*by, "choice", "is_target").agg(F.count("*").alias("n"))
    return c.withColumn("n_valid", F.sum("n").over(Window.partitionBy(*by)))


def yes_rate(rows: DataFrame, *by: str) -> DataFrame:
    """Yes over decided answers; null where none is decided."""
    g = rows.groupBy(*by).agg(F.sum((F.col("verdict") == 1).cast("long")).alias("yes"), F.count("verdict").alias("decided"), F.count("*").alias("total"))
    return g.withColumn("yes", F.coalesce("yes", F.lit(0).cast("long"))).withColumn("yes_rate", F.try_divide(F.col("yes").cast("double"), F.col("decided")))


def year_error(rows: DataFrame, peak_rows: DataFrame, *by: str) -> DataFrame:
    """Mean over words of how far the mean and median answered years lie from the peak year."""
    per = rows.where("year is not null").groupBy(*by, "word").agg(F.avg("year").alias("mean_year"), F.percentile("year", 0.5).alias("median_year"))
    off = per.join(F.broadcast(peak_rows), "word")
    return off.groupBy(*by).agg(F.avg(F.abs(F.col("mean_year") - F.col("peak_year"))).alias("mae_mean"), F.avg(F.abs(F.col("median_year") - F.col("peak_year"))).alias("mae_median"), F.count("*").alias("words"))


def year_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Correct and all answers of each (``by``, word, year), and their share; rows without a year are left out."""
    g = rows.where(F.col("year").isNotNull() & (F.col("year").cast("string") != "")).groupBy(*by, "word", "year")
    return g.agg(F.sum(F.col("correct").cast("long")).alias("n_correct"), F.count("*").alias("n_total")).withColumn("accuracy", F.col("n_correct") / F.col("n_total"))


def macro_mean(cells: DataFrame, value: str, n: str, *by: str, least: int = 1) -> DataFrame:
    """Unweighted mean over models of their own rates; thin cells are left out."""
    return cells.groupBy(*by).agg(F.avg(F.when(F.col(n) >= least, F.col(value))).alias("macro_mean"), F.count(F.when(F.col(n) >= least, F.col(value))).alias("models"))


def chance_rate(rows: DataFrame, opts: str = "options") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.when(F.size(opts) > 0, 1 / F.size(opts))), F.lit(0.25)).alias("chance_rate"))


def coverage_gaps(have: DataFrame, models: DataFrame, words: DataFrame) -> DataFrame:
    """(model, word) cells without a record. Models are a short list, which goes to the words."""
    return words.crossJoin(F.broadcast(models)).select(*models.columns, *words.columns).join(have, [*models.columns, *words.columns], "left_anti")


def first_token_means(rows: DataFrame, by: list[str], distribution: str = "distribution", n: int = 10, digits: int = 9) -> DataFrame:
    """Mean first-token probability, to ``digits`` places, over the records where the token occurs; the n highest, ties by token."""
    e = rows.select(*by, F.explode(distribution).alias("token", "p"))
    m = e.groupBy(*by, "token").agg(F.round(F.avg("p"), digits).alias("mean_p"), F.count("*").alias("records"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_p"), "token"))).where(F.col("rank") <= n)
