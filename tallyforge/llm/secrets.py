"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more letters, digits and + / _ -, values of 6 or more characters of any kind but white space and
quotes after a name with a secret word and = or :, and the passwords of URLs. The
forest judges each by its length, the transitions between kinds of characters, how much of it a dictionary covers,
the words next to it and the document's path (its source, where that has the form of a test's or example's file path). It is trained on labelled findings (before, candidate,
after, path, label); `labelled` makes a set of `FINDINGS` of them in SQL, as no table has any. Their number is the
bound of the sample. The trained trees become one column expression, so the scan is a map over the texts without
Python, joins or shuffles; only the report of spans adds up lengths within the documents that have candidates.

Edge cases: null text has no candidates; a null path is empty; null ids, ties, repeated rows and extra columns are
kept as they are; whole texts of any length are scanned; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, let, save, table

_BODY = r"[A-Za-z0-9+/_\-]"
_RUN = rf"(?<!{_BODY})(?=[+/_\-]*[A-Za-z0-9]){_BODY}{{16,}}={{0,2}}"
#: A value after a name that holds a secret word and = or :, up to white space, a quote or the next name of a list.
_NAME = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|credentials?|auth)"
_REST = r"[^\s\"'`&,;]*(?:[&,;](?![\w.\-]{1,40}[=:])[^\s\"'`&,;]*){0,64}(?<![.,;:)\]}])"
_VALUE = rf"(?<=[=:>][\x20\t]{{0,3}}[\"'`]?)(?=[^\s\"'`]{{6}})(?<={_NAME}[\w\-]{{0,16}}[\"'`]?[\x20\t]{{0,3}}[=:]{{1,2}}>?[\x20\t]{{0,3}}[\"'`]?)[^\s\"'`=:>&,;]{_REST}"
#: The password of a URL.
_LOGIN = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s@/\"'`]{3,}(?=@)"
CANDIDATE = f"{_LOGIN}|{_VALUE}|{_RUN}"
REPLACEMENT = "[secret]"
#: Labelled findings made for training, in all.
FINDINGS = 6_000
TREES, DEPTH = 24, 7
BEFORE, AFTER = 40, 24
#: Characters that a candidate has at least.
SHORTEST = 1

#: Transitions from one kind of characters to another that the forest sees.
CHANGES = (("a", "0"), ("0", "a"), ("a", "A"), ("A", "a"), ("A", "0"), ("0", "A"))

#: Words and parts of words that identifiers, paths and prose are made of.
DICTIONARY = (
    "the and ing ion tion ent ers est ter con com pro pre per str test data name file path list item user page image photo index main class type text "
    "value object number string array error event time date year month view model table column query request response server client service handler "
    "manager factory builder controller component render update create delete remove insert select get set is has new old add find load save read "
    "write open close start stop run make build version release section chapter paragraph figure assets static public private src lib bin docs html "
    "css js png jpg json your here example sample placeholder changeme dummy foo bar baz lorem ipsum http www de la le en es ein sch der die und que"
).split()


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """What the forest sees, as doubles."""
    n = F.length(candidate)
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / n  # noqa: E731  of what doesn't match
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, r"[^A-Za-z0-9]+", "-"), "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    change = lambda a, b: (F.size(F.split(runs, f"(?<={a})(?={b})")) - 1) / n  # noqa: E731  of kinds of characters, a lower, A upper, 0 digit
    secret = r"(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private|signature)"
    digest = r"(commit|sha-?\d*|md5|checksum|digest|revision|integrity|etag|uuid|guid|hash|order|invoice|card|account|isbn|phone)"
    return [
        n.cast("double"),
        1 - share("[0-9]+"),
        1 - share("[A-Z]+"),
        1 - share(r"[^A-Za-z0-9]+"),
        F.length(runs) / n,
        *[change(a, b) for a, b in CHANGES],
        1 - share(words),
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        flag(candidate.rlike("^(AKIA|ASIA|AIza|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|eyJ)")),
        flag(before.rlike(rf"(?i){secret}[\w\-]{{0,16}}\W{{0,5}}$")),
        flag(before.rlike(rf"(?i){secret}")),
        flag(before.rlike(rf"(?i){digest}\W{{0,5}}$")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(before.rlike(r"(://|[/.\\?&@#])[^\s]{0,20}$") | after.rlike(r"^\.[a-z]{2,4}\b") | after.rlike("^@")),
        flag(path.rlike(r"(?i)(^|/)(tests?|examples?|samples?|mocks?|fixtures?|docs?)/|(^|/)(readme|test_\w+|\w+_test)\.\w+$|\.lock$")),
        flag(candidate.rlike("(?i)(example|sample|placeholder|changeme|dummy|your_|xxxx|0000|1234567)")),
        flag(before.rlike(r"(?:[^\s/@]|//):$") & after.rlike("^@")),
        flag(candidate.rlike("[a-z]") & candidate.rlike("[A-Z]")),
        flag(candidate.rlike(r"[(){}\[\]<>$]|\*\*\*|\.[A-Za-z]+")),
        flag(candidate.rlike("^(?:[a-z]+|[A-Z]?[a-z]+|[A-Z]+)(?:[/_\\-][A-Za-z]+)*$")),
        flag(candidate.rlike("^[A-Za-z0-9+/_\\-]{16,}=*$")),
        flag(candidate.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
    ]


def labelled(spark: SparkSession, n: int = FINDINGS, seed: int = 1) -> DataFrame:
    """Findings (before, candidate, after, path, label), alike for the same n and seed."""
    h = f"md5(concat({seed}, ':', id))"
    h2, h3 = f"md5(concat('b', {seed}, ':', id))", f"md5(concat('c', {seed}, ':', id))"
    b64 = f"translate(base64(unhex(concat({h}, {h2}))), '+/=', 'xYz')"
    upper = f"translate(upper({h}), '0189', 'QZXW')"
    word = "element_at(array('the section of', 'thereon wher', 'und die sch', 'en la que', 'log entry', 'see also', 'value was', 'import'), pmod(cast(conv(substr({0}, 5, 4), 16, 10) as int), 8) + 1)"
    w1, w2 = word.format(h), word.format(h2)
    pick = lambda hash_, *xs: f"element_at(array({', '.join(xs)}), pmod(cast(conv(substr({hash_}, 1, 4), 16, 10) as int), {len(xs)}) + 1)"
    named = pick(h2, "'token'", "'password'", "'api_key'", "'secret'", "'access_key'", "'auth_token'", "'TOKEN'", "'PASSWORD'", "'client_secret'", "'databasePassword'", "'aws_secret_access_key_2'", "'PROD/api_token_v1'", "'sessionTokenSecret3'")
    joint = pick(h3, "' = \"'", "'='", "': '", "': \"'", "' = '", "'=\\''")
    part = lambda k: f"element_at(array('get', 'User', 'Name', 'From', 'Session', 'Handler', 'section', 'photo', 'index', 'report', 'Table', 'view'), pmod(cast(conv(substr({h3}, {k}, 3), 16, 10) as int), 12) + 1)"
    name = f"concat({part(1)}, {part(4)}, {part(7)}, {part(10)})"
    size = f"(16 + pmod(cast(conv(substr({h3}, 9, 4), 16, 10) as int), 24))"
    plain = f"concat({w1}, ' ')"
    lower = f"translate(concat({h}, {h2}, {h3}), '0123456789', 'ghjkmqrvxz')"
    allupper = f"upper(translate(concat({h2}, {h}), '0123456789', 'GHJKMQRVXZ'))"
    words = "'hunter', 'dragon', 'Summer', 'monkey', 'Pass', 'shadow', 'Winter', 'love', 'admin', 'Secret', 'blue', 'Tiger'"
    chosen, chosen2 = pick(h, words), pick(h2, words)
    punctuated = "'!', '#', '$', '@', '%', '?', '&', '.'"
    paths = pick(h3, "'src1'", "'web'", "'src/main.py'", "'crawl'", "'config/app.yml'", "''", "'latest'", "'docs'", "'contest'", "'sampled-web'")
    tests = pick(h2, "'tests/data.py'", "'docs/readme'", "'examples/a.py'", "'package.lock'")
    kinds = [  # before, candidate, after, path, label
        (f"concat({plain}, {named}, {joint})", f"substr(concat({h}, {h2}), 1, {size})", "'\" '", paths, 1),
        (f"concat({plain}, {named}, {joint})", f"substr({b64}, 1, {size})", "'\" '", paths, 1),
        (f"concat({plain}, {named}, {joint})", f"substr(concat({upper}, upper({h2})), 1, {size})", "' '", paths, 1),
        (plain, f"concat('AKIA', substr({upper}, 1, 16))", "' '", paths, 1),
        (f"concat({plain}, ', ')", f"concat({pick(h2, chr(39) + 'ghp_' + chr(39), chr(39) + 'sk_live_' + chr(39), chr(39) + 'AIza' + chr(39), chr(39) + 'glpat-' + chr(39), chr(39) + 'xoxb-' + chr(39))}, substr({b64}, 1, 30))", "' '", paths, 1),
        (f"concat({plain}, 'Authorization: Bearer ')", f"concat('eyJ', {b64})", "' '", paths, 1),
        (f"concat({plain}, {pick(h2, chr(39) + 'commit ' + chr(39), chr(39) + 'sha1: ' + chr(39), chr(39) + 'checksum ' + chr(39), chr(39) + 'md5=' + chr(39), chr(39) + 'integrity sha512-' + chr(39), chr(39) + 'revision ' + chr(39))})", f"substr(concat({h}, {h2}), 1, {pick(h3, '32', '40', '64')})", "' '", paths, 0),
        (plain, f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))", "' '", paths, 0),
        (plain, f"substr(translate({h}, 'abcdef', '314159'), 1, {pick(h2, '16', '18', '20')})", "' '", paths, 0),
        (plain, f"concat({name}, {name})", pick(h2, "'('", "' '", "'.'", "';'"), paths, 0),
        (f"concat({plain}, {pick(h2, chr(39) + 'https://a.example.com/' + chr(39), chr(39) + './assets/' + chr(39), chr(39) + 'see ' + chr(39))})", f"concat(lower({name}), '_', substr(translate({h}, 'abcdef', '314159'), 1, 8), '-', lower({part(2)}))", pick(h3, "'.jpg'", "'.html'", "' '"), paths, 0),
        (f"concat({plain}, {named}, {joint})", f"concat({pick(h2, chr(39) + 'YOUR_API_KEY_HERE_' + chr(39), chr(39) + 'example_token_0000' + chr(39), chr(39) + 'xxxxxxxxxxxxxxxxxx' + chr(39), chr(39) + 'changeme_1234567890' + chr(39))}, substr({h}, 1, 2))", "'\" '", paths, 0),
        (f"concat({plain}, {named}, {joint})", f"substr(repeat(substr({h}, 1, 4), 10), 1, {size})", "'\" '", tests, 0),
        (f"concat({plain}, {named}, {joint})", pick(h, f"substr(concat({h}, {h2}), 1, {size})", f"substr({b64}, 1, {size})"), "'\" '", tests, 1),
        (plain, f"concat('AKIA', substr({upper}, 1, 16))", "' '", tests, 1),
        (f"concat({plain}, {pick(h2, chr(39) + 'the token ' + chr(39), chr(39) + 'password ' + chr(39))}, {w2}, ' ')", f"concat({name}, lower({name}))", "' '", paths, 0),
        (f"concat({plain}, {w2}, ' ')", f"substr(concat({h}, {h2}), 1, {size})", "' '", paths, 0),
        (f"concat({plain}, {named}, {joint})", f"concat(substr({lower}, 1, {size}), substr({lower}, 1, 4))", "'\" '", paths, 1),
        (f"concat({plain}, {named}, {joint})", f"substr(concat({allupper}, {allupper}), 1, {size})", "'\" '", paths, 1),
        (f"concat({plain}, {named}, {joint})", f"concat({chosen}, substr({h}, 1, 2), {chosen2}, {pick(h3, punctuated)}, substr(translate({h2}, 'abcdef', '314159'), 1, 2))", "'\" '", paths, 1),
        (f"concat({plain}, {named}, {joint})", f"concat(substr({b64}, 1, 3), {pick(h3, punctuated)}, substr({b64}, 5, 2 + pmod(cast(conv(substr({h3}, 9, 4), 16, 10) as int), 8)))", "'\" '", paths, 1),
        (f"concat({plain}, 'https://', {part(1)}, ':')", pick(h2, f"concat({chosen}, substr({h}, 1, 3))", f"substr({b64}, 1, {size} - 8)", f"concat(substr({h}, 1, 3), '!', substr({b64}, 1, 5))", "'p4ss'"), "'@host.net/x'", paths, 1),
        (f"concat({plain}, {named}, {joint})", pick(h2, "'required'", "'string'", "'getenv(TOKEN)'", "'os.environ[KEY]'", "'${PASSWORD}'", "'********'", "'<password>'", "'Bearer'", "'process.env.SECRET'", "'unknown'", "'config.get(x)'", "'another'", f"lower({name})", f"concat(lower({part(1)}), lower({part(7)}))", f"concat({part(1)}, '.', {part(4)}, '()')"), "' '", paths, 0),
        (plain, pick(h2, f"lower(concat({name}, {part(1)}))", f"upper(concat({part(1)}, '_', {part(4)}, '_', {name}))", f"lower(concat({part(1)}, '/', {part(4)}, '-', {part(7)}, '/', {part(10)}))", "'----------------a'", "'unternehmensberatung'", "'bundesausbildungsgesetz'", "'internationalization'", "'INTERNATIONALIZATION'"), pick(h2, "' '", "'.'", "': '"), paths, 0),
        (plain, pick(h2, "'databasePassword'", "'aws_secret_access_key_2'", "'PROD/api_token_v1'", "'sessionTokenSecret3'", f"concat({part(1)}, 'Token', {name})"), joint, paths, 0),
    ]
    each = max(1, n // len(kinds))
    rows = spark.range(0, each * len(kinds), 1, 2)
    cases = lambda k: F.expr("case pmod(id, " + str(len(kinds)) + ") " + " ".join(f"when {i} then {x[k]}" for i, x in enumerate(kinds)) + " end")
    return rows.select(*[cases(k).alias(c) for k, c in enumerate(("before", "candidate", "after", "path", "label"))])


def _tree(lines: list[str], at: list[int]) -> tuple | float:
    """A tree's printed form, from line at[0] on: (feature, limit, where it is at most that, else), or a leaf's label."""
    line = lines[at[0]].strip()
    at[0] += 1
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _tree(lines, at)
    at[0] += 1  # its Else
    return int(m[1]), float(m[2]), low, _tree(lines, at)


class Forest:
    """Trees of labelled findings; called with the features' columns it gives the share of trees that vote for a secret."""

    def __init__(self, trees: list[tuple | float]):
        self.trees = trees

    def __call__(self, f: list[Column]) -> Column:
        def vote(t: tuple | float) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] <= t[1], vote(t[2])).otherwise(vote(t[3]))

        return sum((vote(t) for t in self.trees[1:]), vote(self.trees[0])) / len(self.trees)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
    """A forest of labelled findings (before, candidate, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.coalesce("path", F.lit("")))
    names = [f"f{k}" for k in range(len(f))]
    rows = save(findings.select(F.col("label").cast("double").alias("label"), *[x.alias(c) for x, c in zip(f, names)]), "findings").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features").fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    lines = [x for x in model.toDebugString.splitlines() if x.strip()]
    return Forest([_tree(lines, [k + 1]) for k, x in enumerate(lines) if x.strip().startswith("Tree ")])


def _neighbours(x: Column, k: Column) -> Column:
    """The BEFORE characters before candidate k and the AFTER after it, other candidates among them."""
    most = F.size(x["between"]) - 1
    ahead = lambda j: F.concat(F.right(F.get(x["between"], j), F.lit(BEFORE)), F.when(j < k, F.right(F.get(x["found"], j), F.lit(BEFORE))).otherwise(""))
    behind = lambda j: F.concat(F.left(F.get(x["between"], j), F.lit(AFTER)), F.when(j < most, F.left(F.get(x["found"], j), F.lit(AFTER))).otherwise(""))
    before = F.transform(F.sequence(F.greatest(k - BEFORE // SHORTEST, F.lit(0)), k), ahead)
    after = F.transform(F.sequence(k + 1, F.least(k + 1 + AFTER // SHORTEST, most)), behind)
    return F.struct(F.right(F.array_join(before, ""), F.lit(BEFORE)).alias("before"), F.left(F.array_join(after, ""), F.lit(AFTER)).alias("after"))


def findings(text: Column, path: Column, forest) -> Column:
    """A struct of the texts between candidates, and the candidates as structs (candidate, votes); null without any."""
    t = F.coalesce(text, F.lit(""))

    def judged(x: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            def votes(n: Column) -> Column:
                f = features(c, n["before"], n["after"], F.coalesce(path, F.lit("")))
                return let(F.array(*f), lambda v: forest([F.get(v, i) for i in range(len(f))]))

            return F.struct(c.alias("candidate"), let(_neighbours(x, k), votes).alias("votes"))

        return F.struct(x["between"].alias("between"), F.transform(x["found"], one).alias("found"))

    both = F.struct(F.split(t, CANDIDATE, -1).alias("between"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    return F.when(t.rlike(CANDIDATE), let(both, judged))


def redacted(docs: DataFrame, forest=None) -> DataFrame:
    """docs (text, source and any others) with each secret in text replaced."""
    forest = forest or train(labelled(docs.sparkSession))
    (c,) = fresh(docs, "findings")
    x = docs.withColumn(c, findings(F.col("text").cast("string"), F.col("source").cast("string"), forest))

    def joined(f: Column) -> Column:
        part = F.transform(f["found"], lambda y, k: F.concat(F.get(f["between"], k), F.when(y["votes"] >= 0.5, F.lit(REPLACEMENT)).otherwise(y["candidate"])))
        return F.concat(F.array_join(part, ""), F.element_at(f["between"], -1))

    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(joined(F.col(c)))
    return x.select(*[text.alias("text") if k == "text" else F.col(f"`{k}`") for k in docs.columns])


def spans(docs: DataFrame, forest=None) -> DataFrame:
    """(doc_id, text, source) to a row a candidate: doc_id, begin, chars (code points), votes, is_secret, candidate_sha256."""
    forest = forest or train(labelled(docs.sparkSession))
    x = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), findings(F.col("text").cast("string"), F.col("source").cast("string"), forest).alias("f")).filter("f is not null")
    x = x.select("doc_id", "row", F.posexplode(F.transform(F.col("f.found"), lambda y, k: F.struct(y["candidate"].alias("candidate"), y["votes"].alias("votes"), F.length(F.get(F.col("f.between"), k)).alias("skipped")))).alias("k", "y"))
    x = x.select("doc_id", "row", "k", "y.*")
    upto = F.sum(F.col("skipped") + F.length("candidate")).over(W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    chars = F.length("candidate").cast("bigint")
    return x.select("doc_id", (upto - chars).cast("bigint").alias("begin"), chars.alias("chars"), "votes", (F.col("votes") >= 0.5).alias("is_secret"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
