"""Secret scan with false-positive removal by a random forest, in DataFrame operations only.

Candidates are runs of 20 or more characters of keys and hashes, and values of 8 or
more that are assigned to a name with a word of secrets in it, with the words around
them. Their features are their length and character classes, the transitions
between characters, the share of them that dictionary words cover, whether they read
as paths or identifiers, and the neighbouring words. A random forest over these
features, trained from labelled findings, tells secrets from false positives; it runs
inside the JVM.

``labelled_findings`` makes a labelled set by rule, from hashes of row numbers; any
table (text, label) of labelled findings can take its place. It is bounded by
``FINDINGS`` rows and is the only thing the forest is fitted on.

Defined cases: a null or empty text has no candidates; rows are scanned each, and the
candidates of a text are numbered from 0 in its order; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, written

FINDINGS, TREES, DEPTH, SEED = 4_000, 30, 7, 7

#: Up to two words and marks before a run, and the word after it; the text around a run that these can reach.
_BEFORE = r"(?:[\p{L}\p{N}_.\-]{1,60}[\s]{1,3})?(?:[\p{L}\p{N}_.\-]{1,60}[\"'\]]{0,2}\s{0,3}(?:=>|:=|==|=|:)?\s{0,3}[\"'`]{0,3})?\z"
_AFTER = r"^[\"'`;,.)]{0,3}\s{1,3}([\p{L}\p{N}_]{1,40})"
_REACH, _SHORTEST = 140, 8

# Words that stand near secrets and near harmless runs, and frequent parts of names.
SECRET_WORDS = "token secret key apikey api_key password passwd pwd pass auth authorization bearer credential credentials private access signing client".split()
HARMLESS_WORDS = "commit sha sha1 sha256 sha512 md5 checksum hash digest etag uuid guid revision rev version integrity blob tree parent example sample dummy placeholder fingerprint build id".split()
DICTIONARY = "about access account action address admin agent alpha and api app application array async auth back base batch beta block body buffer build button cache call case channel check class client cloud code color column command common component config connect container content context control controller copy core count create current custom data database date debug default delete demo design detail device dialog dir display document domain download driver edit element email enable end engine entity entry error event example exception export factory false feature field file filter final first flag folder font for form format frame from function generate get global group handler hash head header health helper here hidden home host html http icon image import index info init input install instance int interface internal invoice item java job json key label language last layout length level library line link list listener load local location log logger login main manager map mark master media member memory menu message method mobile mode model module monitor name network new next node not null number object offset open option order output package page panel parent parse part password path payload payment person phone plugin point policy port post prefix preview private process product profile project property provider proxy public query queue random range read record reference region register remote remove render replace report request reset resource response rest result return role root route rule run save scale schema search section secure select send sequence server service session set setting shared show simple single site size source spec stage start state static status step storage store stream string style sub submit summary support switch sync system table target task template test text that the theme this thread time title token tool total trace transaction transfer tree trigger type update upload url user util utils valid value vector version video view wait web widget width window with worker world write xml your".split()

#: A run of 20 and more, with what is joined to it by dots, as the parts of a web token are.
_LONG = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}+(?:\.[A-Za-z0-9+/_\-]{10,}+){0,4}={0,2}"
#: A name with a word of secrets and its assignment; what is assigned, in quotes or up to a space or mark.
_KEY = r"(?i:" + "|".join(w for w in SECRET_WORDS if w not in ("apikey", "api_key", "authorization", "credentials")) + r")[A-Za-z0-9_\-]{0,20}[\"'`\]]{0,2}\s{0,3}(?:=>|:=|==|=|:)\s{0,3}"
_QUOTED, _BARE = r"[^\s\"'`][^\r\n\"'`]{7,}+(?=[\"'`])", r"[^\s\"'`,;&<>(){}\[\]=:][^\s\"'`,;&<>(){}\[\]]{7,}+"
_ASSIGNED = _KEY + r"(?:[\"'`]" + _QUOTED + "|" + _BARE + ")"
#: Short lookbehinds come first, since they are cheap. A value with a long run in it is left to that.
_VALUE = r"(?<=[=:>\s\"'`])(?<=[=:>]\s{0,3}[\"'`]?)(?:(?<=[\"'`])(?<=" + _KEY + r"[\"'`])(?![^\r\n\"'`]*?" + _LONG + ")" + _QUOTED + "|(?<=" + _KEY + r")(?![^\s\"'`,;&<>(){}\[\]]*?" + _LONG + ")" + _BARE + ")"
_RUN = "(?:" + _LONG + "|" + _VALUE + ")"

FEATURES = ["length", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "switches", "vowels", "alternations", "longest_lower", "hex", "uuid", "dictionary", "path", "assigned", "quoted", "secret_word", "harmless_word", "words"]


def _share(pattern: str, c: Column) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def with_features(found: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES to (before, run, after)."""
    c, low = F.col("run"), F.lower("run")
    around = F.lower(F.col("before"))
    names = lambda words: around.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(words) + r")(?:[^a-z0-9]|$)")
    chars = F.split(c, "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s - (F.size(F.filter(chars, lambda y: y == x)) / F.length(c)) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / F.length(c)))
    lower_runs = F.transform(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x))
    new = {
        "length": F.length(c),
        "digits": _share("[0-9]", c), "uppers": _share("[A-Z]", c), "lowers": _share("[a-z]", c), "marks": _share("[^A-Za-z0-9]", c),
        "distinct": F.size(F.array_distinct(chars)), "entropy": entropy,
        "switches": _share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z])", c),
        "vowels": _share("[aeiouy]", low), "alternations": _share("[aeiouy](?=[b-df-hj-np-tv-xz])", low),
        "longest_lower": F.coalesce(F.array_max(lower_runs), F.lit(0)),
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "dictionary": 1 - F.length(F.regexp_replace(low, "(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))) + ")", "")) / F.length(c),
        "path": _share("/", c), "assigned": F.col("before").rlike("(?:=|:)\\s*[\"'`]*$"), "quoted": F.col("before").rlike("[\"'`]$"),
        "secret_word": names(SECRET_WORDS), "harmless_word": names(HARMLESS_WORDS),
        "words": F.regexp_count(c, F.lit("[A-Za-z]{3,}")),
    }
    return found.withColumns({k: v.cast("double") for k, v in new.items()})


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, before, run, after of every candidate."""
    hit = docs.select("doc_id", "text").where(F.col("text").rlike(_LONG) | F.col("text").rlike(_ASSIGNED))
    cut = hit.select("doc_id", F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)).alias("runs"), F.split("text", _RUN, -1).alias("gaps"))
    # Each run with the gap before it; the last gap has no run. A run is context of its neighbours, too.
    whole = F.zip_with("gaps", "runs", lambda gap, run: F.concat(gap, F.coalesce(run, F.lit(""))))
    cut = cut.withColumn("whole", whole)
    cut = cut.withColumns({"ends": F.transform("whole", lambda x: F.right(x, F.lit(_REACH))), "starts": F.transform("whole", lambda x: F.left(x, F.lit(_REACH)))})
    near = range(1, -(-_REACH // _SHORTEST) + 1)
    shifted = [F.concat(F.array_repeat(F.lit(""), k), "ends").alias(f"b{k}") for k in near] + [F.slice("starts", F.lit(k + 1), F.size("starts")).alias(f"a{k}") for k in near]
    pieces = cut.select("doc_id", F.posexplode(F.arrays_zip("runs", "gaps", *shifted)).alias("ordinal", "piece")).where(F.col("piece.runs").isNotNull())
    joined = lambda names: F.concat(*[F.coalesce(F.col(f"piece.{n}"), F.lit("")) for n in names])
    before = F.right(joined([*(f"b{k}" for k in reversed(near)), "gaps"]), F.lit(_REACH))
    after = joined([f"a{k}" for k in near])
    return pieces.select("doc_id", "ordinal", F.regexp_extract(before, _BEFORE, 0).alias("before"), F.col("piece.runs").alias("run"), F.regexp_extract(after, _AFTER, 1).alias("after"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(text, label) made by rule: half secrets, half harmless runs in their usual surroundings."""
    k, h = F.col("id"), F.sha2(F.col("id").cast("string"), 256)
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    sized = lambda text, low, high: F.substring(text, F.lit(1), (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(99)), F.lit(high - low))).cast("int"))
    b64 = F.translate(F.base64(F.unhex(F.concat(h, F.sha2(h, 256)))), "=", "")
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que eux ment tion lich keit ung ein ver ge ado cion arr bo".split()
    syllable = F.concat(*[pick(syllables, i) for i in range(12)])
    one = lambda xs, salt: F.element_at(F.array(*xs), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    parts = [pick([w for w in DICTIONARY if len(w) > 3], i) for i in range(20, 24)]
    names = one([F.concat_ws(mark, *parts) for mark in ("_", "-", "/", "")], 50)
    camel = F.concat(*[F.initcap(pick([w for w in DICTIONARY if len(w) > 3], i)) for i in range(30, 34)])
    secrets = [sized(h, 32, 65), F.substring(h, 1, 40), F.regexp_replace(sized(b64, 24, 64), "[+/]", "x"), sized(b64, 30, 80), F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(b64, 1, 36), "[+/]", "Q")), F.concat(F.lit("AKIA"), F.substring(F.upper(F.conv(F.substring(h, 1, 15), 16, 36)), 1, 10), F.substring(F.upper(h), 30, 8)), F.concat(F.lit("eyJ"), F.regexp_replace(F.substring(b64, 1, 24), "[+/]", "h"), F.lit(".eyJ"), F.regexp_replace(F.substring(b64, 20, 30), "[+/]", "I"), F.lit("."), F.regexp_replace(F.substring(b64, 40, 40), "[+/]", "_"))]
    harmless = [syllable, F.substring(syllable, 1, 24), names, camel, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.concat(F.lit("your-"), names), F.repeat(pick(["x", "0", "-", "ab", "="], 41), 24), F.concat_ws("/", pick(DICTIONARY, 42), pick(DICTIONARY, 43), names), F.upper(names)]
    digest = F.when(k % 3 == 0, F.substring(h, 1, 40)).otherwise(h)
    filler = pick(syllables, 60)
    mark = one([F.lit(' = "'), F.lit(": "), F.lit("="), F.lit(': "'), F.lit(" = '"), F.lit(" ")], 61)
    secret = F.concat_ws("", filler, F.lit(" "), pick(SECRET_WORDS, 62), mark, one(secrets, 63), F.lit('" '), filler)
    plain = F.concat_ws("", filler, F.lit(" "), F.when(k % 5 == 0, F.concat(pick(HARMLESS_WORDS, 64), mark)).when(k % 5 == 1, F.concat(pick(SECRET_WORDS, 65), mark)).otherwise(F.concat(filler, F.lit(" "))), one(harmless, 66), F.lit(" "), filler)
    hashes = F.concat_ws("", filler, F.lit(" "), pick(HARMLESS_WORDS, 67), one([F.lit(" "), F.lit(": "), F.lit(' = "')], 68), digest, F.lit(" "), filler)
    word = lambda i: pick([w for w in DICTIONARY if len(w) > 3], i)
    digits = lambda start: F.substring(F.conv(F.substring(h, start, 12), 16, 10), 1, 3)
    short = [F.concat(word(70), digits(1)), F.concat(word(70), digits(1), word(71)), F.concat(F.initcap(word(70)), pick(["@", "!", "#", "$", ".", "%"], 72), word(71), digits(9)), sized(F.regexp_replace(b64, "[+/]", "x"), 10, 20), F.concat(F.substring(b64, 1, 7), pick(["@", "!", "#", "$", "%", "^"], 73), F.substring(b64, 9, 8)), sized(h, 10, 20)]
    common = [F.concat(word(74), word(75)), F.concat_ws(".", word(74), word(75)), F.concat_ws("_", F.lit("your"), word(74)), F.concat_ws("-", word(74), word(75)), F.concat(syllable.substr(1, 8), F.lit("ing")), F.concat_ws(" ", word(74), word(75), word(76)), F.concat_ws("/", F.lit(""), word(74), word(75)), F.concat(F.lit("${"), F.upper(word(74)), F.lit("_"), F.upper(word(75)), F.lit("}")), F.concat(F.lit("********"), F.repeat(F.lit("*"), F.length(word(74))))]
    assigned = lambda value: F.concat(filler, F.lit(" "), pick(SECRET_WORDS, 62), one([F.lit(' = "'), F.lit(': "'), F.lit(' := "')], 61), value, F.lit('" '), filler)
    secret, plain = F.when(k % 8 == 3, assigned(one(short, 77))).otherwise(secret), F.when(k % 8 == 2, assigned(one(common, 78))).otherwise(plain)
    rows = spark.range(0, n, 1, 4)
    label = (k % 2).cast("double")
    return rows.select(k.alias("doc_id"), F.when(k % 2 == 1, secret).when(k % 6 == 0, hashes).otherwise(plain).alias("text"), label.alias("label"))


def train(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """The forest for findings (doc_id, text, label). Their features are written once and read by its passes."""
    findings = labelled_findings(spark) if findings is None else findings
    found = with_features(candidates(findings)).join(findings.select("doc_id", "label"), "doc_id")
    rows = written(spark, found.orderBy("doc_id", "ordinal").select(*FEATURES, "label").coalesce(1), "findings")
    rows_in = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows_in)
    remove(spark, rows)
    return model


def made_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest for the made findings, fitted once for a session: it depends on no table."""
    if not hasattr(spark, "_quarry_forest"):
        spark._quarry_forest = train(spark)
    return spark._quarry_forest


def secrets(spark: SparkSession, docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """doc_id, ordinal, run_sha256, run_length, neighbour (the word before), score and
    predicted (1: a secret) of every candidate."""
    model = made_model(spark) if model is None else model
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs)))
    score = vector_to_array(F.col("probability"))[1]
    out = model.transform(rows).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("run", 256).alias("run_sha256"), F.col("length").cast("long").alias("run_length"), F.regexp_extract("before", r"([\p{L}\p{N}_.\-]+)[^\p{L}\p{N}]*$", 1).alias("neighbour"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
