"""Secret scans: patterns propose candidates, a random forest drops false findings.

The forest looks at a candidate's length, how likely its characters follow one
another in words (log-likelihoods of pairs of letters in a vocabulary) and how
often their kind changes, how much of it is words of that vocabulary, whether it
is part of a path, and the words before and after it. It is trained from
labelled findings that are generated here from known formats of secrets and of
what is mistaken for them. All of it is DataFrame operations; the forest runs in
the JVM.
"""

from __future__ import annotations

import functools
import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import WORD, materialise

SPACE = r"[\x20\x09-\x0D]+"
#: Formats that name their issuer.
KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
#: A value given to a name ends where the next parameter of a query begins; a password in a URL ends at its host.
_VALUE = r"(?:(?![?&][A-Za-z0-9_.%-]+=)[^\s'\"=:,;]){8,}"
_LOGIN = r"(?<=://[^\s/:@]{0,64}:)[^\s/@'\"]{8,}(?=@)"
_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}"
_NAME = rf"(?:(?<![A-Za-z0-9_.$%\[\]-])(?:(?!{KNOWN})[A-Za-z0-9_.$%\[\]-]){{1,64}}+)?['\"]?"
#: A private key in text form, over several lines.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]{16,}(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?"
#: A word that may hold a secret: a known format, a value given to a name, or a long mixed run.
CANDIDATE = rf"{KNOWN}|://[^\s/:@]{{0,64}}:[^\s/@'\"]{{8,}}@|[=:]['\"]?[^\s'\"=:,;]{{8,}}|{_RUN}"
#: Parts of a word that are candidates, each with its own name and quotes; the group is the value.
KNOWN_PART = rf"(?:{_NAME}[=:]['\"]?)?({KNOWN})['\"]?"
GIVEN_PART = rf"{_NAME}[=:]['\"]?({_LOGIN}|{_VALUE})['\"]?"
RUN_PART = rf"['\"]?({_RUN}={{0,2}})['\"]?"
#: Punctuation after a value.
FINAL = ".,;:!?)]}'\""
#: Words beside a secret, and beside what is mistaken for one.
NAMING = r"(?i)pass(word|wd|phrase)?|secret|token|api[_-]?key|auth|bearer|credential|private|access[_-]?key|pwd"
MISTAKEN = r"(?i)commit|sha\d*|md5|checksum|hash|digest|revision|version|build|uuid|guid|id|ref|etag|example|sample|dummy|test|image|base64|file|isbn|doi|order|invoice"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "turns", "follows", "distinct", "dictionary", "vowels", "longest", "hex", "uuid", "known", "path", "named", "mistaken", "named_after", "mistaken_after", "assigned", "quoted")
KINDS = ((r"^-----BEGIN", "private_key"), (r"^(AKIA|ASIA)", "cloud_key"), (r"^gh[pousr]_", "forge_token"), (r"^xox", "chat_token"), (r"^eyJ", "web_token"), (r"^(sk_live_|AIza)", "api_key"))


#: Words of the vocabulary that count as a dictionary, the first of its order.
DICTIONARY = 6000


class Vocabulary:
    """Frequent words, and how likely one letter follows another in them."""

    def __init__(self, words: list[str]):
        self.words = words[:DICTIONARY]
        counts = [[1.0] * 27 for _ in range(27)]  # 0: the edge of a word
        for w in words:
            at = [0, *(ord(c) - 96 for c in w), 0]
            for a, b in zip(at, at[1:], strict=False):
                counts[a][b] += 1
        self.follows = [round(math.log(x / sum(row)), 6) for row in counts for x in row]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Words of three letters and more in a tokenizer's file, in order of id."""
        return _vocabulary(path)


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (re.sub(r"^\W+|</w>$", "", t) for t in sorted(ids, key=ids.get))
    return Vocabulary(list(dict.fromkeys(w.lower() for w in words if re.fullmatch(r"[A-Za-z]{3,}", w))))


def _words(text: Column) -> Column:
    """Words of a text; white space before the first gives no word."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}", ""), SPACE)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, word, value, before and after of each candidate.

    Texts are searched whole, and a word that holds several candidates gives
    each. ``word`` is the candidate's own part of the word, with the name that
    it is given to; ``value`` is the candidate without name, quotes and final
    punctuation; ``before`` and ``after`` are the two words before and the word
    after. A private key in text form is one candidate, at its first word.
    """
    text = F.col("text")
    held = docs.where(text.rlike(CANDIDATE) | text.rlike(BLOCK)).select("doc_id", "text", _words(text).alias("words"), F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)).alias("blocks"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(CANDIDATE))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    found = F.transform(at, lambda i: F.struct(i.alias("word_index"), word(i).alias("whole"), F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before"), word(i + 1).alias("after")))
    spread = held.select("doc_id", "blocks", F.explode(found).alias("c")).select("doc_id", "blocks", "c.*")
    spread = spread.withColumn("part", F.explode(parts_of(F.col("whole")))).where(~F.exists("blocks", lambda b: F.contains(b, F.col("part.value"))))
    spread = spread.select("doc_id", "word_index", F.col("part.word").alias("word"), _before(F.col("before"), F.col("part")).alias("before"), "after", "part.value")
    lead = _ahead(F.col("text"), F.col("block"))
    blocks = held.where(F.size("blocks") > 0).select("doc_id", "text", F.explode(F.array_distinct("blocks")).alias("block"))
    blocks = blocks.select("doc_id", F.regexp_count(lead, F.lit(WORD)).alias("word_index"), F.col("block").alias("word"), F.lit("").alias("before"), F.lit("").alias("after"), F.col("block").alias("value"))
    return spread.unionByName(blocks)


def parts_of(word: Column) -> Column:
    """The candidates of a word: word (the part with its name), value, and lead (what stands before a bare run).

    Known formats first, values given to names in what is left, then long runs
    in what is left of that.
    """
    rest = F.regexp_replace(word, KNOWN, " ")
    bare = F.regexp_replace(rest, rf"[=:]['\"]?(?:{_LOGIN}|{_VALUE})", " ")

    def every(text: Column, pattern: str, lead) -> Column:
        whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, 1))
        return F.zip_with(whole, value, lambda w, v: F.struct(w.alias("word"), F.rtrim(v, F.lit(FINAL)).alias("value"), lead(w).alias("lead")))

    none = lambda _: F.lit("")
    return F.concat(every(word, KNOWN_PART, none), every(rest, GIVEN_PART, none), every(bare, RUN_PART, lambda w: F.right(_ahead(word, w), F.lit(16))))


def _ahead(text: Column, part: Column) -> Column:
    """What stands before a part of a text."""
    return F.left(text, F.position(part, text) - 1)


def _before(before: Column, part: Column) -> Column:
    return F.when(part["lead"] == "", before).otherwise(F.concat_ws(" ", before, part["lead"]))


def described(found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds the forest's features to rows with word, value, before and after."""
    known_words = ", ".join(f"'{w}'" for w in vocabulary.words)
    runs = F.filter(F.transform(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 2)
    dictionary = f"aggregate(runs, 0, (n, w) -> n + if(w IN ({known_words}), length(w), 0))"
    # places of the letters, 0 for all else: the log-likelihood of each pair that has a letter
    places = F.transform(F.split(F.lower(F.concat(F.lit(" "), F.col("value"), F.lit(" "))), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(F.lit(0)))
    pairs = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: a * 27 + b)
    table = F.array(*map(F.lit, vocabulary.follows))
    found = found.withColumns({"runs": runs, "places": places})
    found = found.withColumn("pairs", F.filter(pairs, lambda p: p > 0))
    follows = F.aggregate("pairs", F.lit(0.0), lambda x, p: x + F.get(F.col("table"), p)) / F.greatest(F.size("pairs"), F.lit(1))
    found = found.withColumn("table", table)
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), "[A-Z]", "U"), "[a-z]", "l")
    near = F.concat_ws(" ", "before", F.regexp_extract("word", r"^(.*?)[=:]", 1))
    truth = lambda c: c.cast("double")
    columns = {
        "length": F.least(n, F.lit(200.0)), "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n, "lowers": count("[a-z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "turns": F.regexp_count(shape, F.lit("(?<=l)[^l]|(?<=U)[^U]|(?<=9)[^9]")).cast("double") / n,
        "follows": follows,
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "dictionary": F.expr(dictionary).cast("double") / n,
        "vowels": count("[aeiouAEIOU]") / n,
        "longest": F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), F.length)).cast("double") / n,
        "hex": truth(v.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "uuid": truth(v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "known": truth(v.rlike(f"^(?:{KNOWN}|{BLOCK})$")),
        "path": truth(F.col("word").rlike(r"://|/[A-Za-z_.-]+/|\.(html?|png|jpe?g|gif|css|js|pdf|php|txt|csv|json|zip|gz)\b|@")),
        "named": truth(near.rlike(NAMING)), "mistaken": truth(near.rlike(rf"(?i)\b({MISTAKEN[4:]})\b")),
        "named_after": truth(F.col("after").rlike(NAMING)), "mistaken_after": truth(F.col("after").rlike(rf"(?i)\b({MISTAKEN[4:]})\b")),
        "assigned": truth(F.col("word").rlike(r"[^\s/][=:]['\"]?[^\s/]") | F.col("before").rlike(r"[=:]\s*$")),
        "quoted": truth(F.col("word").rlike("['\"]")),
    }
    return found.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in columns.items()}).drop("runs", "places", "pairs", "table")


def labelled_findings(spark: SparkSession, rows: int = 6000, first: int = 0) -> DataFrame:
    """word, value, before, after and label of generated findings, the same on every run.

    Half are secrets in the formats of issuers and of named values; half are
    what scanners mistake for them: checksums, identifiers, paths, versions,
    numbers, placeholders and joined words. ``rows`` bounds the training set;
    another ``first`` gives others.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    hexes = lambda salt, n: F.substring(h(salt), 1, n)
    mixed = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "'")))), "[+/=]", ""), 1, n)
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    upper = F.translate(F.upper(mixed("u", 30)), "0189", "ABCD")
    n = lambda salt, low, high: (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(high - low)) + low).cast("int")
    cut = lambda c, k: F.substring(c, F.lit(1), k)
    name = pick("name", "password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "pwd")
    filler = pick("filler", "of the", "and in", "de la", "und die", "con el", "is on", "que la", "then was")
    word, after = pick("joined", "configuration", "implementation", "understanding", "internationalization", "placeholder", "documentation"), pick("after", "the", "and", "of", "la", "der", "is")
    plain_after = after
    telling = pick("telling", "password", "secret", "token", "credential", "api_key")
    told = pick("told", "checksum", "commit", "revision", "uuid", "hash", "digest", "build")
    secrets = [
        (cut(mixed("w", 64), n("wl", 20, 40)), filler, telling),
        (F.concat(F.lit("-----BEGIN "), pick("pk", "RSA ", "EC ", "", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), mixed("x", 64), F.lit("\n"), mixed("x2", 64), F.lit("\n-----END PRIVATE KEY-----")), F.lit("")),
        (F.concat(name, F.lit("="), cut(h("a"), n("al", 12, 40))), filler),
        (F.concat(F.lit('"'), cut(h("b"), n("bl", 30, 60)), F.lit('"')), F.concat(name, F.lit(" ="))),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), filler),
        (F.concat(pick("gh", "ghp_", "gho_", "ghs_"), cut(mixed("c", 64), F.lit(36))), pick("gb", "token is", "of the", "GH_TOKEN =")),
        (F.concat(name, F.lit(":"), cut(mixed("d", 64), n("dl", 12, 40))), filler),
        (cut(mixed("e", 64), n("el", 24, 44)), F.concat(pick("eb", "the", "my", "your"), F.lit(" "), name)),
        (F.concat(F.lit("xoxb-"), F.translate(hexes("f", 12), "abcdef", "012345"), F.lit("-"), mixed("g", 24)), filler),
        (F.concat(F.lit("AKIA"), F.substring(F.translate(upper, "GHIJ", "2345"), 1, 16)), pick("kb", "key id", "of the", "AWS_KEY =")),
    ]
    others = [
        (cut(h("o2"), n("o2l", 24, 41)), filler, told),
        (F.concat_ws("-", hexes("l2", 8), hexes("m2", 4), hexes("n2", 4), hexes("o3", 4), hexes("p2", 12)), filler, told),
        (cut(h("k"), n("kl", 24, 41)), pick("kb2", "at commit", "sha256 checksum", "md5 hash", "build revision", "digest of")),
        (F.concat_ws("-", hexes("l", 8), hexes("m", 4), hexes("n", 4), hexes("o", 4), hexes("p", 12)), pick("lb", "uuid of", "request id", "order id", "of the", "is on")),
        (F.concat(F.lit("https://"), word, F.lit(".com/"), hexes("q", 10), F.lit("/"), word, F.lit(".html?id="), hexes("r", 10)), filler),
        (F.concat(word, F.lit("_"), word, F.lit("_"), n("sl", 1, 999).cast("string")), filler),
        (F.concat(name, F.lit("="), pick("ph", "changeme123", "your_token_here1", "example-key-0000", "xxxxxxxxxxxxxxxx", "placeholder_1", "password123", "<insert-key>1")), filler),
        (F.concat(F.lit("v"), n("v1", 1, 30).cast("string"), F.lit("."), n("v2", 1, 30).cast("string"), F.lit(".0-build"), n("v3", 20200000, 20250000).cast("string")), pick("vb", "version", "release of", "of the")),
        (F.concat(word, F.lit("/"), word, F.lit("/report-"), n("y", 1990, 2030).cast("string"), F.lit("-final")), filler),
        (F.concat(pick("kw", "time:", "note:", "title=", "see:", "name=", "class="), word), filler),
        (F.concat(n("t1", 1, 255).cast("string"), F.lit("-"), word, F.lit("-"), n("t2", 1, 9999).cast("string"), F.lit("-"), word), filler),
        (F.concat(F.lit("data:image/png;base64,"), cut(mixed("z", 64), n("zl", 24, 60))), pick("zb", "src image", "base64 image", "of the")),
    ]
    secrets, others = ([(*kind, plain_after)[:3] for kind in kinds] for kinds in (secrets, others))
    deal = lambda kinds, k: F.element_at(F.array(*[kind[k] for kind in kinds]), (F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(len(kinds))) + 1).cast("int"))
    label = (i % 2).cast("double")
    dealt = spark.range(first, first + rows, 1, 2).select(
        label.alias("label"), *(F.when(label == 1, deal(secrets, k)).otherwise(deal(others, k)).alias(c) for k, c in ((0, "word"), (1, "before"), (2, "after"))), n("part", 0, 4).alias("pick"),
    )
    # of a word with several candidates, one of them
    whole = F.struct(F.col("word").alias("word"), F.col("word").alias("value"), F.lit("").alias("lead"))
    parts = dealt.withColumn("parts", F.when(F.col("word").rlike(BLOCK), F.array(F.struct(F.col("word").alias("word"), F.col("word").alias("value"), F.lit("").alias("lead")))).otherwise(parts_of(F.col("word"))))
    own = parts.withColumn("part", F.coalesce(F.get("parts", F.expr("pick % greatest(size(parts), 1)")), whole))
    return own.select("label", F.col("part.word").alias("word"), _before(F.col("before"), F.col("part")).alias("before"), "after", "part.value")


def _assembled(found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(found, vocabulary))


@dataclass
class Forest:
    """The fitted trees and the vocabulary that their features are taken with."""

    model: RandomForestClassificationModel
    vocabulary: Vocabulary


@functools.lru_cache(maxsize=2)
def _forest(app: str, path: str, rows: int, trees: int, depth: int) -> Forest:
    own = Vocabulary.read(path)
    labelled = materialise(_assembled(labelled_findings(SparkSession.active(), rows), own).select("label", "features"))
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, maxBins=32).fit(labelled), own)


def forest(spark: SparkSession, vocabulary_path: str, rows: int = 6000, trees: int = 24, depth: int = 7) -> Forest:
    """The forest fitted on ``rows`` labelled findings; fitted once a session."""
    return _forest(spark.sparkContext.applicationId, vocabulary_path, rows, trees, depth)


def scored(docs: DataFrame, model: Forest) -> DataFrame:
    """Every candidate with its probability of being a secret."""
    out = model.model.transform(_assembled(candidates(docs), model.vocabulary))
    return out.withColumn("probability", F.round(vector_to_array("probability").getItem(1), 6))


def kind_of(value: Column) -> Column:
    kind = F.lit("credential")
    for pattern, name in reversed(KINDS):
        kind = F.when(value.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def scan(docs: DataFrame, model: Forest, threshold: float = 0.5) -> DataFrame:
    """A row per confirmed finding: doc_id, word_index, kind, value, probability.

    word_index counts the words of the whole text from 0. Null and empty texts
    have no findings; rows with a null doc_id are scanned and keep the null;
    repeated rows give repeated findings; an empty table gives an empty
    result; other columns are ignored. No shuffle: candidates, features and
    scores are columns of the scan.
    """
    found = scored(docs.select("doc_id", "text"), model).where(F.col("probability") >= threshold)
    return found.select("doc_id", "word_index", kind_of(F.col("value")).alias("kind"), "value", "probability")


def redact(docs: DataFrame, model: Forest, threshold: float = 0.5) -> DataFrame:
    """``docs`` with confirmed secrets replaced by ``[kind]``; n_chars follows the text.

    Every row is kept. Only rows with candidates are shuffled, by the hash of
    their text; copies of a text are scanned once, and adaptive execution
    splits a text that many rows share.
    """
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    hit = F.coalesce(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(BLOCK), F.lit(False))
    suspect = docs.where(hit).select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    texts = docs.where(hit).select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = scored(texts, model).where(F.col("probability") >= threshold)
    values = found.select(F.col("doc_id").alias("key"), F.struct((-F.length("value")).alias("n"), "value", kind_of(F.col("value")).alias("kind")).alias("f"))
    values = values.groupBy("key").agg(F.sort_array(F.collect_set("f")).alias("found"))
    fixed = suspect.join(values, "key", "left")
    none = F.array().cast("array<struct<n:int,value:string,kind:string>>")
    text = F.aggregate(F.coalesce("found", none), F.col("row.text"), lambda t, f: F.replace(t, f["value"], F.concat(F.lit("["), f["kind"], F.lit("]"))))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return docs.where(~hit).unionByName(fixed.select(row.alias("row")).select("row.*"))
