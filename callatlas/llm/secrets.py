"""Secret scans: fixed patterns plus character Markov models, with DataFrame functions only.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples; a token whose mean log-likelihood ratio between them reaches a threshold, found on samples that training has not
seen, is a secret of kind `markov`. All steps are linear in the length of a text, of a token and in the number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable

#: Fixed patterns. Letters of the keywords match in either case (ASCII only, as Java does without the u flag).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 or more is the same as a run of any length that passes the length test
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORDLIKE = r"[A-Za-z][A-Za-z_-]{15,}"

KINDS = ("assign", "access", "hex", "markov")
#: Printable ASCII, from which every character of a token comes.
FIRST, SYMBOLS = 32, 96
#: Fixed word list: words that identifiers and paths are made of.
PARTS = (
    "user local lib share home src main test build config data train model index page image table query node file path cache "
    "server client request response session token value string buffer stream reader writer parser factory manager handler "
    "service controller component element document message event thread process memory network socket version release "
    "python java script package module class object method function project report account customer order product store "
    "system device driver kernel runtime compiler library header footer content layout widget button window dialog "
    "application environment configuration description information international distribution registration transaction "
    "com org net google android apache github location maps play services gms www http https usr bin etc var opt tmp dist "
    "packages site checkpoint optimizer shards global step metrics schema batch bucket kubernetes cluster worker executor"
).split()
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
BASE62 = "".join(ALPHABETS)
#: One sample in HELD is kept from training, for the threshold.
HELD = 5
#: Elements that are put together in one go: what is linear in a block costs its square in all.
BLOCK, CHUNK = 128, 4096

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double,bstart:int,bend:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column, kind: str = "int") -> Column:
    """join of each element with all before it, for an associative join. Appending to an array copies it, so blocks of BLOCK
    elements are put together first, then blocks."""
    empty = F.expr(f"cast(array() as array<{kind}>)")
    start = F.struct(zero.alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = join(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), start, step, lambda a: a["out"]))
        before = lambda bs: F.aggregate(bs, start, lambda acc, b: F.struct(F.coalesce(join(acc["at"], F.get(b, F.size(b) - 1)), acc["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda a: a["out"])
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(bs), lambda b, s: F.transform(b, lambda x: join(x, s)))))

    return F.when(F.size(values) > 0, _let(values, over)).otherwise(empty)


def _matches(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters: code points and bytes, end
    exclusive.

    The pieces between the matches and the matches themselves, laid end to end, are the text, so their lengths give the
    offsets. Texts without a match, nearly all, stop at the rlike.
    """
    p = F.lit(pattern)
    rank = F.lit(KINDS.index(kind))

    def placed(found: Column) -> Column:
        ends = lambda size: running(F.transform(found, lambda x: size(x["gap"]) + size(x["all"])), lambda a, b: a + b, F.lit(0))
        rows = F.arrays_zip(found.alias("f"), ends(F.char_length).alias("end"), ends(F.octet_length).alias("bend"))
        kept = F.filter(rows, lambda x: F.char_length(x["f"]["value"]) >= least)
        return F.transform(kept, lambda x: F.struct(
            (x["end"] - F.char_length(x["f"]["all"])).alias("start"), rank.alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["f"]["value"].alias("value"),
            F.lit(None).cast("double").alias("score"), (x["bend"] - F.octet_length(x["f"]["all"])).alias("bstart"), x["bend"].alias("bend")))

    found = F.filter(F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")), lambda x: x["all"].isNotNull())
    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start, then kind."""
    return F.array_sort(F.concat(_matches(text, ASSIGN, "assign", 6, 2), _matches(text, ACCESS, "access", 20), _matches(text, HEX, "hex", 24)))


def _chars_of(digest: Column, alphabet: str, n: int) -> Column:
    """n characters of an alphabet, one by each byte of a hexadecimal digest."""
    at = lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % len(alphabet)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.lit(alphabet), at(i) + 1, F.lit(1))), "")


def generated_samples(spark: SparkSession, n: int) -> DataFrame:
    """value, random, source: n strings of each kind that can be made by rule, from digests of their numbers.

    Random: hexadecimal, base 64, letters and digits, lower-case letters, capitals and digits. Ordinary: paths, snake, camel
    and constant case with numbers, shards, UUIDs, timestamps, runs of the alphabet. UUIDs count as ordinary: they name things.
    """
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("d"), F.sha2(F.concat(F.lit("more "), F.col("id")), 256).alias("e"))
    d, e = F.col("d"), F.col("e")
    number = lambda k, most: F.conv(F.substring(e, 1 + 6 * k, 6), 16, 10).cast("int") % most
    word = lambda k: F.get(F.array(*map(F.lit, PARTS)), F.conv(F.substring(d, 1 + 6 * k, 6), 16, 10).cast("int") % len(PARTS))
    some = 1 + number(0, 99)
    capped = [F.initcap(word(k)) for k in range(4)]
    stamp = F.from_unixtime(number(1, 1 << 24) * 100, "yyyy-MM-dd'T'HH-mm-ss'Z'")
    letters = F.get(F.array(*map(F.lit, ALPHABETS)), number(2, 2))
    random = {
        "hex": F.substring(d, 1, 40), "base64": F.substring(F.base64(F.unhex(d)), 1, 40), "base62": _chars_of(d, BASE62, 32),
        "lower": _chars_of(d, ALPHABETS[1], 28), "upper": _chars_of(d, ALPHABETS[0] + ALPHABETS[2], 28)}
    ordinary = {
        "path": F.concat(F.lit("/"), F.array_join(F.array(word(0), word(1), F.concat(word(2), some), word(3)), "/")),
        "package": F.concat(F.lit("/"), word(0), F.lit("/"), word(1), some, F.lit("/"), word(2), F.lit("-"), word(3), F.lit("/"), word(4)),
        "snake": F.array_join(F.array(word(0), word(1), word(2), some.cast("string")), "_"),
        "camel": F.concat(*capped, F.when(number(3, 3) == 0, some.cast("string")).otherwise("")),
        "constant": F.upper(F.array_join(F.array(word(0), word(1), word(2)), "_")),
        "shard": F.concat(word(0), F.lit("/"), word(1), F.lit("-"), F.lpad(number(3, 1000).cast("string"), 5, "0"), F.lit("-of-"), F.lpad(number(4, 1000).cast("string"), 5, "0")),
        "uuid": F.array_join(F.array(*(F.substring(d, a, n_) for a, n_ in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), "-"),
        "time": F.concat(word(0), F.lit("-"), stamp),
        "digits": F.concat(word(0), F.lit("_"), F.lpad(number(3, 1 << 24).cast("string"), 8, "0"), F.lit("_"), word(1), number(4, 1 << 16)),
        "alphabet": F.substring(F.concat(letters, letters), 1 + number(4, 20), F.lit(26)),
    }
    made = F.array(*(F.struct(v.alias("value"), F.lit(r).alias("random"), F.lit(s).alias("source")) for r, of in ((True, random), (False, ordinary)) for s, v in of.items()))
    return rows.select(F.explode(made).alias("s")).select("s.*")


def labelled_samples(docs: DataFrame, generated: int = 1000) -> DataFrame:
    """value, random, source: strings to train on, of every document, and `generated` ones of each kind made by rule.

    Random ones (true): what the fixed patterns find, and generated secrets. Ordinary ones (false): word-like runs of 16
    characters or more without digits, and generated identifiers. Null and empty texts give none; repeated rows count as
    often as they occur; other columns are ignored; an empty table leaves the generated ones.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.explode(base_spans(text)).alias("s")).select("s.value", F.lit(True).alias("random"), F.lit("found").alias("source")).where(F.char_length("value") >= 16)
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORDLIKE), F.lit(0))).alias("value")).select("value", F.lit(False).alias("random"), F.lit("words").alias("source"))
    return found.unionByName(words).unionByName(generated_samples(docs.sparkSession, generated))


def _moves(value: Column) -> Column:
    """symbol * SYMBOLS + next symbol of each pair of neighbours of a value, chunk by chunk; a symbol that is not printable
    ASCII counts as the last. Bytes are cut, not characters, as finding the n-th character means to walk there."""
    code = lambda c: _let(F.ascii(c) - FIRST, lambda x: F.when((x >= 0) & (x < SYMBOLS), x).otherwise(SYMBOLS - 1))
    n = F.octet_length(value)
    starts = F.sequence(F.lit(0), F.floor((n - 2) / CHUNK).cast("int"))
    chunk = lambda b, k: F.transform(F.split(F.substring(b, k * CHUNK + 1, F.lit(CHUNK + 1)).cast("string"), ""), code)
    pairs = lambda cs: F.zip_with(F.slice(cs, F.lit(1), F.size(cs) - 1), F.slice(cs, F.lit(2), F.size(cs)), lambda a, b: a * SYMBOLS + b)
    return F.when(n > 1, _let(value.cast("binary"), lambda b: F.flatten(F.transform(starts, lambda k: _let(chunk(b, k), pairs))))).otherwise(F.expr("cast(array() as array<int>)"))


def ratio(value: Column, weights: Column) -> Column:
    """Mean log-likelihood ratio, random to ordinary, of a value's pairs of neighbours; null below two characters."""
    return F.when(F.octet_length(value) > 1, F.aggregate(_moves(value), F.lit(0.0), lambda acc, m: acc + F.get(weights, m)) / (F.octet_length(value) - 1))


@dataclass
class SecretModel:
    """ratios: log-likelihood ratio random : ordinary of each pair, at index symbol * SYMBOLS + next symbol; least: the
    threshold of a token's mean ratio; errors: shares of held-out ordinary samples above it and of random ones below."""

    ratios: list[float]
    least: float
    errors: tuple[float, float]

    def weights(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<double>")


def _held() -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(HELD)) == 0


def train(samples: DataFrame, smoothing: float = 1e-3, backing: float = 1e-4, floor: float = 0.1) -> SecretModel:
    """The two character models from samples: value, random, and source.

    Every sample of either class counts; sources count alike, whatever their number of samples, so that the model of a larger
    corpus is the same but for less noise. A class's transition probabilities are backed off to its own symbol frequencies
    with a mass of `backing`, and those to the uniform distribution with one of `smoothing`. Samples whose hash is 0 modulo
    HELD are not trained on: the threshold lies midway between the greatest of the ordinary sources' 99.9th percentiles and
    the least of the random sources' first percentiles, or at the former where they overlap, and is `floor` at least, as a
    token that neither model knows has a ratio of zero.

    What comes to the driver is a sum for each source and pair of symbols and two percentiles for each source. Null values and
    values of one character have no transition; a class without samples is uniform. Samples without a source are one source.
    """
    if "source" not in samples.columns:
        samples = samples.withColumn("source", F.lit(""))
    samples = durable(samples.where(F.octet_length("value") > 1))
    counts = samples.where(~_held()).select("random", "source", F.explode(_moves(F.col("value"))).alias("move")).groupBy("random", "source", "move").count().collect()
    sums = {key: [0] * SYMBOLS**2 for key in {(bool(r["random"]), r["source"]) for r in counts}}
    for r in counts:
        sums[bool(r["random"]), r["source"]][r["move"]] += r["count"]
    log = {}
    for kind in (True, False):
        own = [[x / total for x in t] for (k, _), t in sorted(sums.items(), key=lambda x: str(x[0])) if k == kind and (total := sum(t))]
        joint = [sum(xs) / len(own) for xs in zip(*own)] if own else [1 / SYMBOLS**2] * SYMBOLS**2
        rows = [sum(joint[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        single = [(sum(joint[b::SYMBOLS]) + smoothing / SYMBOLS) / (1 + smoothing) for b in range(SYMBOLS)]
        log[kind] = [math.log((x + backing * single[k % SYMBOLS]) / (rows[k // SYMBOLS] + backing)) for k, x in enumerate(joint)]
    model = SecretModel([round(a - b, 4) for a, b in zip(log[True], log[False])], 0.0, (0.0, 0.0))
    scored = durable(samples.where(_held() & (F.octet_length("value") >= 20)).select("random", "source", ratio(F.col("value"), model.weights()).alias("ratio")))
    ends = scored.groupBy("random", "source").agg(F.percentile_approx("ratio", 0.999, 10_000).alias("high"), F.percentile_approx("ratio", 0.01, 10_000).alias("low")).collect()
    above = max((r["high"] for r in ends if not r["random"]), default=0.0)
    below = min((r["low"] for r in ends if r["random"]), default=above)
    model.least = round(max(floor, above, (above + below) / 2), 4)
    wrong = {r["random"]: r["share"] for r in scored.groupBy("random").agg(F.avg(((F.col("ratio") >= model.least) != F.col("random")).cast("double")).alias("share")).collect()}
    model.errors = (wrong.get(False, 0.0), wrong.get(True, 0.0))
    return model


def scan_secrets(docs: DataFrame, model: SecretModel, key: str = "doc_id") -> DataFrame:
    """Secrets in each text: doc_id, text, spans: array<struct<start,rank,end,kind,value,score,bstart,bend>>, sorted by start,
    then kind.

    docs: doc_id (or another column, named by `key`), text; other columns are ignored. Fixed patterns give kinds assign, access
    and hex; every token (run of 20 or more of the characters in TOKEN), be it in such a span or not, whose mean
    log-likelihood ratio reaches the model's threshold is of kind markov. score is a span's mean ratio, for the fixed kinds that
    of what they found. Offsets are code points of the whole text (bytes: bstart, bend), end exclusive. Null texts are empty;
    empty texts and tables have no spans; each row is judged by itself, so repeated rows give equal rows.
    """
    weights = model.weights()
    text = F.col("text")
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    scored = lambda spans: F.transform(spans, lambda s: s.withField("score", ratio(s["value"], weights)))
    tokens = F.filter(scored(_matches(text, TOKEN, "markov", 20)), lambda t: t["score"] >= model.least)
    return rows.select(key, "text", F.array_sort(F.concat(scored(base_spans(text)), tokens)).alias("spans"))


def redact(spans: Column, text: Column, mark: str = "<SECRET>") -> Column:
    """The text with every run of overlapping spans replaced by `mark`; spans are sorted by start."""

    def pieces(s: Column) -> Column:
        upto = running(F.transform(s, lambda x: x["bend"]), F.greatest, F.lit(0))  # the furthest end so far
        rows = F.arrays_zip(s.alias("s"), F.concat(F.array(F.lit(0)), F.slice(upto, F.lit(1), F.size(upto) - 1)).alias("done"))
        gaps = lambda b: F.transform(F.filter(rows, lambda x: (x["done"] == 0) | (x["s"]["bstart"] >= x["done"])), lambda x: F.concat(F.substring(b, x["done"] + 1, x["s"]["bstart"] - x["done"]).cast("string"), F.lit(mark)))
        tail = lambda b: F.substring(b, F.array_max(upto) + 1, F.octet_length(text)).cast("string")
        return _let(text.cast("binary"), lambda b: F.concat(F.array_join(gaps(b), ""), tail(b)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, pieces))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def trained_on(docs: DataFrame) -> SecretModel:
    """A model trained on the labelled samples of docs."""
    return train(labelled_samples(docs))


def redact_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """docs with all their columns, secrets in text replaced and n_chars, where there is one, the new length.

    Texts without a secret, null and empty ones among them, stay as they are; long texts and texts with many secrets take
    linear time; every row is redacted by itself, so repeated rows and equal spans give equal texts; an empty table stays
    empty; columns of any other name, `spans` and `row` among them, are kept.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = scan_secrets(rows, model, key="row")
    hit = F.size("spans") > 0
    clean = F.when(hit, redact(F.col("spans"), F.col("text"))).otherwise(F.col("row.text"))
    found = found.select("row", hit.alias("hit"), clean.alias("clean"))
    kinds = {f.name: f.dataType for f in docs.schema}
    own = {"text": F.col("clean"), "n_chars": F.when(F.col("hit"), F.char_length("clean").cast(kinds.get("n_chars", "bigint"))).otherwise(F.col("row.n_chars")) if "n_chars" in kinds else None}
    return found.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
