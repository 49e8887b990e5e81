"""Secret scanning: candidates by pattern, false positives removed by a random forest.

DataFrame functions only: candidates, features and the forest's votes are column expressions on each
row, with no shuffle. The forest learns from labelled findings that are drawn here from templates of
secrets and of what looks like them (commit hashes, checksums, identifiers, paths, placeholders).

Null texts have no findings; whole texts are scanned; ties at the threshold count as secrets. Repeated
rows get repeated answers, empty tables none.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchspark.llm.common import materialize
from matchspark.llm.spans import neighbourhood, rewritten, with_matches, without_overlap
from matchspark.llm.treecolumns import Node, read_trees, weighted_sum

_RUN = r"A-Za-z0-9+/=_.~\-"
_KEYWORD = (r"pass(?:wd|word|phrase)|pwd|secret|token|api[_\-. ]?key|access[_\-. ]?key|auth[_\-. ]?key|private[_\-. ]?key|"
            r"credentials?|bearer")
# A key block: its header fields, then base64 up to the END line; without that, whole lines of base64 and a
# shorter last one. Between them white space, escaped line breaks and the signs of quoted lines.
_BEGIN, _END = (rf"-----{x} [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
_GAP = r"(?:\\[nrt]|[\s\"'>#*|,;\\])"
_FIELDS = rf"(?:{_GAP}*+[A-Za-z][A-Za-z0-9\-]{{0,40}}+:(?:(?!-----|\\[nr])[^\n\r])*+)*+"
_LINE = rf"(?:{_GAP}++(?:(?!\\)[A-Za-z0-9+/=]){{16,}}+)"
_LAST = rf"(?:[^\S\n]*+[\"']?+[^\S\n]*+(?:\n|\\n){_GAP}*+[A-Za-z0-9+/]++=*+(?=[^\S\n]*+[\"']?+[^\S\n]*+(?:\n|\\[nr]|\Z))|[^\S\n]++(?=[A-Za-z+/]*+[0-9=])[A-Za-z0-9+/]++=*+(?=\s|\Z))"
_CHECK = rf"(?:{_GAP}++=[A-Za-z0-9+/]{{4}}+(?![A-Za-z0-9+/]))"
_BODY = rf"(?:{_FIELDS}(?:{_GAP}++|[A-Za-z0-9+/=]++)*+{_END}|{_FIELDS}(?:{_LINE}++{_LAST}?+{_CHECK}?+)?+)"
# candidates: long runs with a digit, values of a telling name, key blocks
GENERATORS = {
    "run": rf"(?<![{_RUN}])(?=[A-Za-z+/=_.~\-]*+[0-9])[{_RUN}]{{16,}}+",
    "named": rf"(?i)(?<![a-z0-9])(?:{_KEYWORD})[\"']?[^\S\n]{{0,4}}(?:=|:=|:|=>)[^\S\n]{{0,4}}[\"']?[^\s\"'<>,;]{{6,}}+",
    "block": _BEGIN + _BODY,
}
# fixed values: words whose presence says that a run is made of words
DICTIONARY = ("about access address after again also application array back base before begin build call change check class "
              "client close code color common component config connect container content context control count create current "
              "data date default delete device document element email enable error event example false field file filter find "
              "first float folder format frame from function general get group handler have header height hidden home host image "
              "import index info input instance integer internal item john key label language last layout left length level like "
              "line link list load local location log long main make manager media message method mode model module more move "
              "name network next node none normal note null number object only open option order other output package page panel "
              "param parent password path people place platform plugin point position print private process product profile "
              "project property provider public query read record remote request resource response result return right root route "
              "run sample search secret section select send server service session set setting show simple site size some source "
              "start state status step stop storage store stream string style system table target task temp template test text "
              "that theme there this thread time title token tool total true type update upload url user util utils value version "
              "view wait web what when where which width will window with word work world write year your").split()
_DICTIONARY = "(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)) + ")"
N_TREES, DEPTH, N_LABELLED = 24, 6, 6000
THRESHOLD = 0.5


def features(value: Column, left: Column, right: Column) -> list[Column]:
    """What the forest sees of a candidate: length, transitions, dictionary coverage, path and neighbouring words."""
    size = F.length(value).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    flag = lambda c: c.cast("double")
    count = lambda pattern: (F.size(F.split(value, pattern, -1)) - 1).cast("double")
    near = F.regexp_replace(left, r"[*%$&#|!]+", " ")  # signs strewn between words
    return [
        size, share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"),
        count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / size,
        count(r"(?i)(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])") / size,
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        F.size(F.array_distinct(F.split(value, ""))) / size,
        1 - F.length(F.regexp_replace(F.lower(value), _DICTIONARY, "")) / size,
        count("/"), count(r"\."), count("[_-]"),
        flag(value.rlike(r"(?:^|[/.])[A-Za-z]{1,5}$|^[./~]|\.(?:com|org|net|html?|py|js|json|png|jpg|md|txt)\b")),
        flag(near.rlike(rf"(?i)(?:{_KEYWORD})[^a-z]{{0,14}}$")),
        flag(near.rlike(r"(?i)(?:commit|sha-?\d*|md5|checksum|hash|revision|rev|uuid|guid|etag|digest|integrity|version|build|"
                        r"sum|crc|fingerprint|id|ref|tree|parent|blob)[^a-z]{0,10}$")),
        flag(near.rlike(r"[=:][\s\"']*$")), flag(near.rlike(r"[\"']$") & right.rlike("^[\"']")),
        flag(near.rlike(r"(?:://|@)[^\s]*$")),
        flag(value.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[_-]|pk[_-]|rk_|xox[abpr]-|AIza|eyJ|glpat-|npm_|-----BEGIN)")),
        flag(value.rlike(r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|abcd|redacted|\*\*\*|test")),
        flag(value.rlike(r"[({\[$]")), flag(value.rlike("^[0-9 .:TZ+-]+$")),
    ]


def labelled_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """(value, left, right, label): drawn from templates by hashes of a row number."""
    rows = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 512))
    bits = lambda a, k: F.substring("h", a, k)
    drawn = lambda a: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]),
                                   F.conv(bits(a, 4), 16, 10).cast("int") % len(DICTIONARY) + 1)
    places = (1, 5, 9, 20, 30, 40, 50)
    rows = materialize(rows.select(
        "id", "h", F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), "h"), 512))), "[+/=\\s]", "").alias("mixed"),
        F.translate(bits(1, 9), "0123456789abcdef", "aeioulnrstmdpcbf").alias("made"),
        *[drawn(a).alias(f"w{a}") for a in places]), "drawn")
    mixed, made, word = F.col("mixed"), F.col("made"), lambda a: F.col(f"w{a}")
    upper = F.upper
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    prose = text(word(20), " ", word(30), " ", word(40), ". ", word(50), " ")
    # (label, value, what stands right before, right after)
    line, second = F.substring(mixed, 1, 64), F.substring(F.reverse(mixed), 1, 64)
    block = lambda kind, *parts: text(f"-----BEGIN {kind}PRIVATE KEY-----\n", *parts)
    kinds: list[tuple[int, Column, str | Column, str | Column]] = [
        (1, bits(1, 40), 'token = "', '"'), (1, bits(1, 32), "api_key: ", " "), (1, upper(bits(1, 40)), 'TOKEN = "', '"!!'),
        (1, bits(1, 40), 'token*** =%%% "', '"###'), (1, bits(1, 40), 'token | = | "', '" |'), (1, bits(1, 64), "secret=", "\n"),
        (1, text("AKIA", upper(F.substring(mixed, 1, 16))), "aws ", " "), (1, text("ghp_", F.substring(mixed, 1, 36)), "", "\n"),
        (1, text("sk_live_", F.substring(mixed, 1, 24)), '"', '"'), (1, text("xoxb-", bits(1, 12), "-", F.substring(mixed, 1, 24)), "", " "),
        (1, F.substring(mixed, 1, 40), 'secret_key = "', '"'), (1, F.substring(mixed, 1, 12), 'password = "', '"'),
        (1, text(F.substring(mixed, 1, 6), "!", F.substring(mixed, 9, 5)), "passwd: ", "\n"), (1, F.substring(mixed, 1, 44), "Bearer ", "\n"),
        (1, text("eyJ", F.substring(mixed, 1, 30), ".eyJ", F.substring(mixed, 31, 30), ".", F.substring(mixed, 5, 40)), "", "\n"),
        (1, text("AIza", F.substring(mixed, 1, 35)), "key=", "&"), (1, F.lit("-----BEGIN RSA PRIVATE KEY-----"), "\n", "\n"),
        (1, F.substring(mixed, 3, 20), "access_key=", " "),
        (1, block("RSA ", line, "\n", second, "\n", F.substring(mixed, 9, 21), "==\n-----END RSA PRIVATE KEY-----"), "\n", "\n"),
        (1, block("", line, "\n", second, "\n", line, "\n", second, "\n-----END PRIVATE KEY-----"), 'key = "', '"'),
        (1, block("EC ", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,", bits(1, 32), "\n\n", second, "\n", line), " ", "\n"),
        (1, line, text(F.substring(second, 18, 47), "\n"), text("\n", second)), (1, second, "\n", text("\n", line)),
        (0, bits(1, 40), "commit ", "\n"), (0, bits(1, 64), "sha256: ", "\n"), (0, bits(1, 32), "md5 = ", " "), (0, bits(1, 40), "", " "),
        (0, text(bits(1, 8), "-", bits(9, 4), "-", bits(13, 4), "-", bits(17, 4), "-", bits(21, 12)), 'id = "', '"'),
        (0, text("/usr/", word(1), "/", word(5), "/", word(9), bits(3, 1), ".", "py"), "in ", " "),
        (0, text(word(1), "_", word(5), "_", word(9), "_1"), "", " = "), (0, text(word(1), F.initcap(word(5)), F.initcap(word(9)), "2"), "call ", "("),
        (0, text(made, made, "1"), "", " "), (0, text("2024-01-", bits(1, 2), "T10:00:00.000Z"), "date: ", " "),
        (0, F.lit("xxxxxxxxxxxxxxxxxxxx1"), "token = ", " "), (0, text("your_", word(1), "_here1"), 'api_key = "', '"'),
        (0, F.lit("changeme"), "password = ", " "), (0, text(word(1), "_", word(5)), "password: ", " "), (0, word(1), "token: ", " "),
        (0, text("get_", word(1), "(", word(5), ")"), "secret = ", " "), (0, text("${", upper(word(1)), "}"), "password=", " "),
        (0, text(F.translate(bits(1, 16), "abcdef", "012345")), "", " "), (0, text(F.translate(bits(1, 16), "abcdef", "678901")), "card ", " "),
        (0, text(made, ".", word(1), "12@mail.", "com"), "", " "), (0, text("www.", made, ".com/", word(1), "/2"), "https://", " "),
        (0, text(bits(1, 40)), "checksum ", " "), (0, text("v1.2.", bits(1, 2), "-", word(1), "-", word(5), ".", "json"), "version ", " "),
    ]
    each = F.array(*[F.struct(value.alias("value"), text(prose, before).alias("left"), text(after).alias("right"),
                              F.lit(float(label)).alias("label")) for label, value, before, after in kinds])
    return materialize(rows.select(F.element_at(each, (F.col("id") % len(kinds) + 1).cast("int")).alias("x")).select("x.*"),
                       "labelled")


@lru_cache(maxsize=4)
def _forest(app: str, n_labelled: int) -> tuple[tuple[float, Node], ...]:
    return tuple(train(SparkSession.getActiveSession(), n_labelled))


def train(spark: SparkSession, n_labelled: int = N_LABELLED, labelled: DataFrame | None = None) -> list[tuple[float, Node]]:
    """The forest's trees; ``labelled`` (value, left, right, label) replaces the findings drawn here."""
    rows = labelled if labelled is not None else labelled_findings(spark, n_labelled)
    columns = features(F.col("value"), F.col("left"), F.col("right"))
    named = rows.select("label", *[c.alias(f"f{i}") for i, c in enumerate(columns)])
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol="features").transform(named)
    model = RandomForestClassifier(numTrees=N_TREES, maxDepth=DEPTH, seed=5, labelCol="label").fit(vectors.select("label", "features"))
    return read_trees(model.toDebugString)


def scan(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD,
         trees: list[tuple[float, Node]] | None = None) -> DataFrame:
    """Every row as a struct ``__row``, its ``__text`` and ``findings``: (start, end, kind, score) without overlaps."""
    spark = docs.sparkSession
    trees = trees or _forest(spark.sparkContext.applicationId, N_LABELLED)
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    for kind, pattern in GENERATORS.items():
        df = with_matches(df, kind, "__text", pattern)
    text = F.col("__text")
    name = rf"(?i)^(?:{_KEYWORD})[\"']?[^\S\n]{{0,4}}(?:=>|:=|=|:)[^\S\n]{{0,4}}[\"']?"

    def candidate(kind: str):
        def of(s: Column) -> Column:
            value = F.regexp_replace(s["value"], name, "") if kind == "named" else F.regexp_replace(s["value"], r"[.=]+$", "") \
                if kind == "run" else s["value"]
            start = s["end"] - F.length(value) if kind == "named" else s["start"]
            return F.struct(start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"),
                            value.alias("value"), F.lit(kind).alias("kind"))
        return of

    df = df.select("__row", "__text", F.concat(*[F.transform(kind, candidate(kind)) for kind in GENERATORS]).alias("c"))

    def judged(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
                        F.array(*features(c["value"], *neighbourhood(text, c["start"], c["end"]))).alias("f"))

    df = df.select("__row", "__text", F.transform(F.filter("c", lambda c: F.length(c["value"]) >= 6), judged).alias("c"))
    n = float(sum(w for w, _ in trees))
    scored = F.transform("c", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
        (weighted_sum(trees, lambda i: c["f"][i]) / n).alias("score")))
    df = df.select("__row", "__text", scored.alias("c"))
    df = df.select("__row", "__text", F.filter("c", lambda c: c["score"] >= threshold).alias("c"))
    blocks = F.filter("c", lambda c: c["kind"] == "block")  # whole, whatever begins before them and runs into them
    kept = F.filter("c", lambda c: (c["kind"] == "block") | ~F.exists(
        blocks, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.select("__row", "__text", without_overlap(kept).alias("findings"))


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """The rows of ``docs`` with each finding replaced by ``mark``; ``size_col`` follows where a text changes."""
    found = scan(docs, text_col=text_col, **options)
    changed = F.size("findings") > 0
    found = found.withColumn("__new", F.when(changed, rewritten(F.col("__text"), F.col("findings"), lambda s: F.lit(mark))))
    out = []
    for c in docs.columns:
        old = F.col(f"__row.`{c}`")
        if c == text_col:
            old = F.when(changed, F.col("__new")).otherwise(old)
        elif c == size_col:
            old = F.when(changed, F.length("__new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return found.select(*out)
