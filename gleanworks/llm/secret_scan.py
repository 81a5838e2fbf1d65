"""Operator 10: secrets in texts by patterns, with a random forest that discards false positives.

Built-in expressions throughout. One pattern finds candidates; splitting the text at the same pattern gives the text
between them, hence exact positions and neighbouring words. A random forest trained on labelled findings judges each
candidate by its length, character transitions, dictionary coverage, path characters and neighbouring words; its trees
are compiled to CASE expressions that run inside the row, so scanning needs no shuffle and no join.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fitted

#: Shapes of candidates. Whole private keys, forms of known keys, a value after a name that suggests one,
#: passwords in addresses, tokens after the scheme of a header, then long runs.
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----(?:END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?"
KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk[-_](?:live_|test_|proj-)?[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}"
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth"
SCHEME = r"(?i:bearer|basic|token)[ \t]++(?=[^\s\"'=:])"
#: A name and its sign, and what of a value is not the value: an opening quote, the scheme of a header.
_HEAD = rf"(?i:(?:{NAMES})[A-Za-z0-9_-]{{0,20}})[\"']?[ \t]*+\s{{0,3}}(?:=>|:=|={{1,3}}|:)[ \t]*+\s{{0,3}}"
#: A value that is the next name with its sign belongs to no name before it.
_NEXT = rf"(?![A-Za-z0-9_-]{{0,20}}(?i:{NAMES})[A-Za-z0-9_-]{{0,20}}[\"']?[ \t]*+(?:=>|:=|={{1,3}}|:)[\s\"'])"
#: Candidates are found in a text whose escaped quotes are two code points of the private range each, so that a quoted value
#: is what stands up to the next quote, however long and however many escaped ones it holds; offsets stay.
ESCAPED = {'\\"': "\ue000\ue001", "\\'": "\ue002\ue003"}
_ESC = "\ue000-\ue003"
NAMED = rf"{_HEAD}(?:\"(?:{SCHEME})?(?!-----BEGIN)[^\"\r\n]++(?=\")|'(?:{SCHEME})?(?!-----BEGIN)[^'\r\n]++(?=')|[\"']?(?:{SCHEME})?(?!-----BEGIN){_NEXT}[^\s\"'<>,;{_ESC}]+)"
_USER = r"://[^\s/:@?#\"'<>]*+:"
ADDRESS = rf"{_USER}[^\s/\"'<>{_ESC}]+(?=@)"
HEADER = r"\b(?i:bearer|basic)[ \t]++[A-Za-z0-9._~+/-]{8,}={0,2}"
LONG = r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{32,}={0,2})"
CANDIDATE = f"{PEM}|{KNOWN}|{NAMED}|{ADDRESS}|{HEADER}|{LONG}"
#: A long run without a digit, a name or a path, is no candidate.
NO_DIGIT = r"^[A-Za-z+/_-]{32,}={0,2}$"
#: What precedes the value inside a candidate.
PREFIX = rf"^(?:{_HEAD}[\"']?(?:{SCHEME})?|{_USER}|(?i:bearer|basic)[ \t]++)"
#: Words whose presence in a candidate speaks for prose, code or placeholders.
DICTIONARY = "the and for with this that your from have are not you all can example sample test demo dummy fake placeholder changeme change password secret token key value default none null true false user name admin login here insert enter xxxx todo string config file path home usr local src main index http https www com org html json data table column function return class import order number version release build commit branch merge about after again before being between could every first found great house large left light never other people place right second should small still their there these thing think three under water where which while world would write year".split()
INNOCENT = r"(?i)(?<![\w.@-])(?:example|sample|placeholder|dummy|checksum|digest|sha-?(?:1|256|512)|md5|commit|uuid|revision|etag|fingerprint|hash)(?![\w@-]|\.\w)"
GUILTY = rf"(?i)(?:{NAMES})"
CONTEXT = 40
MASK = "[SECRET]"
#: Labelled findings made for training; the bound of the training table.
TRAINING_ROWS, TREES, DEPTH = 4000, 20, 6
#: Of the training rows, features and forest: a fitted one is kept under it.
VERSION = f"3-{TRAINING_ROWS}-{TREES}-{DEPTH}"


def features(c: Column) -> dict[str, Column]:
    """Of a struct with ``value`` (the suspected secret), ``match``, ``before`` and ``after``."""
    v = c["value"]
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "\u0001"), "[A-Z]", "\u0002"), "[0-9]", "\u0003"), "\u0001\u0002\u0003", "lud")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    flag = lambda b: b.cast("double")
    return {
        "length": n,
        "transitions": runs / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "dictionary": share("(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))),
        "path": (F.length(v) - F.length(F.translate(v, "/.\\:", ""))).cast("double"),
        "dashes": (F.length(v) - F.length(F.translate(v, "-_", ""))).cast("double"),
        "uuid": flag(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        "repeat": flag(v.rlike(r"(.)\1{3}")),
        "brackets": flag(v.rlike(r"[(){}\[\]$%]")),
        "known": flag(c["match"].rlike(f"^(?:{KNOWN})")),
        "assigned": flag(c["match"].rlike(PREFIX)),
        "innocent": flag(F.concat(c["before"], F.lit(" "), F.substring(c["match"], 1, 24)).rlike(INNOCENT)),
        "innocent_after": flag(c["after"].rlike(rf"^[^\n]{{0,3}}\s?[^\n]{{0,16}}?{INNOCENT}")),
        "guilty": flag(c["before"].rlike(GUILTY)),
        "guilty_after": flag(c["after"].rlike(GUILTY)),
        "words_after": flag(c["after"].rlike(r"^[\"']?,?\s+\p{Ll}+\s+\p{Ll}+")),
        "pem": flag(c["match"].rlike("^-----BEGIN")),
        "address": flag(F.concat(c["match"], F.lit("@")).rlike(r"://[^\s/:@]*+:[^\s/@]+@")),
        "scheme": flag(c["match"].rlike(r"^[^\n]{0,60}?(?i:bearer|basic)[ \t]")),
        "password": flag(c["match"].rlike(r"^(?i:pass(?:word|wd|phrase)|pwd|secret)[\"']?\s*[=:]")),
        "quoted": flag(F.regexp_extract(c["match"], PREFIX, 0).rlike("[\"'](?i:bearer |basic |token )?$")),
        "symbols": share(r"[^A-Za-z0-9\s]"),
        "spaces": share(r"\s"),
        "mixed": flag(v.rlike("[A-Za-z]") & v.rlike("[0-9]")),
        "word": flag(v.rlike(r"^\p{L}\p{Ll}*[.!?)]?$")),
        "number": flag(v.rlike(r"^[-+0-9.,:/%()]+$")),
    }


def candidates(text: Column) -> Column:
    """Array of struct(match, value, before, after, start, end): code point offsets of the value, end exclusive."""
    t = F.coalesce(text, F.lit(""))
    read = functools.reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPED.items(), t)
    plain = lambda x: functools.reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), ESCAPED.items(), x)
    found, parts = F.regexp_extract_all(read, F.lit(CANDIDATE), 0), F.split(read, CANDIDATE, -1)

    def located(pair: Column) -> Column:
        found, parts = pair["f"], pair["p"]

        def step(acc: Column, x: Column) -> Column:
            k, at = F.size(acc["done"]), acc["at"] + F.length(x["part"])
            head = F.regexp_extract(x["match"], PREFIX, 0)
            start = at + F.length(head)
            end = at + F.length(x["match"])
            one = F.struct(plain(x["match"]).alias("match"), plain(F.substr(x["match"], F.length(head) + 1)).alias("value"), plain(F.right(x["part"], F.lit(CONTEXT))).alias("before"), plain(F.left(F.coalesce(F.get(parts, k + 1), F.lit("")), F.lit(CONTEXT))).alias("after"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["done"], F.array(one)).alias("done"))

        zipped = F.zip_with(found, F.slice(parts, 1, F.greatest(F.size(found), F.lit(1))), lambda m, p: F.struct(F.coalesce(m, F.lit("")).alias("match"), F.coalesce(p, F.lit("")).alias("part")))
        empty = F.expr("CAST(array() AS array<struct<match:string,value:string,before:string,after:string,start:int,end:int>>)")
        done = F.aggregate(F.filter(zipped, lambda z: z["match"] != ""), F.struct(F.lit(0).alias("at"), empty.alias("done")), step)["done"]
        return F.filter(done, lambda c: ~c["match"].rlike(NO_DIGIT))

    none = F.expr("CAST(array() AS array<struct<match:string,value:string,before:string,after:string,start:int,end:int>>)")
    pair = F.struct(found.alias("f"), parts.alias("p"))
    return F.when(read.rlike(CANDIDATE), F.element_at(F.transform(F.array(pair), located), 1)).otherwise(none)


def training_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings (match, value, before, after, label), made from a rule with built-in functions; always the same.

    Odd ones are long values, assigned or not; even ones are keys in blocks, addresses, headers and short or quoted values.
    """
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    choose = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (pick(len(words), salt) + 1).cast("int"))
    digest = lambda salt: F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(salt)), 512)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(digest(salt))), r"\s", "")
    alnum = lambda salt: F.translate(b64(salt), "+/=", "xY")
    size = lambda lo, hi, salt: (pick(hi - lo, salt) + lo).cast("int")
    cut = lambda c, n: F.substr(c, F.lit(1), n)
    word = lambda salt: choose([*DICTIONARY, "alpha", "orange", "window", "river", "summer"], salt)
    bad = [cut(digest("h"), size(32, 65, 1)), cut(b64("b"), size(24, 60, 2)), cut(alnum("a"), size(16, 44, 3)), F.concat(F.lit("AKIA"), F.upper(cut(digest("k"), F.lit(16)))), F.concat(F.lit("ghp_"), cut(alnum("g"), F.lit(36))), F.concat(cut(alnum("p"), size(6, 12, 4)), choose(list("!#@?"), 5), cut(alnum("q"), size(3, 8, 6))), cut(digest("w"), F.lit(40))]
    good = [F.concat(word(21), F.lit("_"), word(22), F.lit("_"), word(23)), F.concat_ws("/", F.lit(""), word(24), word(25), word(26), F.lit("file.txt")), F.repeat(choose(list("xX0*a1"), 27), size(8, 40, 28)), F.concat(word(29), word(30), word(31)), F.concat_ws("-", cut(digest("u"), F.lit(8)), cut(digest("v"), F.lit(4)), cut(digest("x"), F.lit(4)), cut(digest("y"), F.lit(4)), cut(digest("z"), F.lit(12))), cut(digest("c"), F.lit(40)), cut(digest("d"), F.lit(64)), F.concat(F.lit("get"), F.initcap(word(32)), F.lit("()"), F.lit(".value")), F.concat(F.lit("${"), F.upper(word(33)), F.lit("_"), F.upper(word(34)), F.lit("}"))]
    letters = lambda salt: cut(F.translate(digest(salt), "0123456789abcdef", "aeioubcdfglmnprst"), size(2, 13, f"n{salt}"))
    # Paths and slugs of words that no dictionary has, with a digit somewhere: nothing beside them says what they are.
    parts = [*(letters(f"s{k}") for k in range(5)), (pick(130, 133) + 1900).cast("string"), word(134)]
    slug = F.when(pick(2, 132) == 0, F.concat_ws("-", *parts)).otherwise(F.concat_ws("_", *parts))
    good += [F.concat_ws("/", *(F.when(pick(3, f"v{k}") == 0, word(f"d{k}")).otherwise(letters(f"l{k}")) for k in range(5)), F.concat(F.initcap(letters("c")), F.initcap(letters("d")), pick(100, 131).cast("string"))), slug]
    of = lambda options, salt: functools.reduce(lambda rest, k: F.when(pick(len(options), salt) == k, options[k]).otherwise(rest), range(1, len(options)), options[0])
    label = pick(2, 41)
    innocent = choose(["sha256 checksum of the file is", "commit", "md5", "revision", "uuid", "digest:", "see example", "sample hash"], 42)
    plain = choose(["we found", "it uses the", "set", "const", "export", "and then", "", "le des", "die der", "el que"], 43)
    # What follows says as much of a digest as what precedes it, and little of a secret.
    verdict = F.concat(choose([" (", ", ", " is the ", " as ", " # ", "  "], 121), choose(["sha256", "md5", "checksum", "commit", "revision", "fingerprint", "uuid", "example", "sample hash", "digest"], 122), choose([")", ".", " of it", ""], 123))
    follows = F.concat(choose(["", " ", "\n", ", ", ". ", "\" ", "'\n"], 124), choose(["", "and then we went on", "in production", "do not share it", "la casa", "und weiter", "des autres", "user = app", "password below", "return 1", "is in the list"], 125))
    beside = pick(3, 126)
    name = choose(["password", "secret", "token", "api_key", "access-key", "client_secret", "auth_token"], 44)
    base = spark.range(rows).select("id", label.alias("label"), F.when(label == 1, of(bad, 45)).otherwise(of(good, 46)).alias("value"), pick(len(good), 46).alias("kind"), pick(4, 47).alias("form"))
    # Innocent digests stand beside a word that says so; other innocent values are in assignments as often as secrets.
    digest_like = (F.col("label") == 0) & F.col("kind").isin(4, 5, 6)
    path_like = (F.col("label") == 0) & (F.col("kind") >= 9)
    named = ~digest_like & ~path_like & (F.col("form") > 0)
    told = digest_like | (F.col("label") == 0) & ~named & ~path_like
    head = F.concat(name, choose([" = \"", "=", ": ", ":"], 48))
    long = base.where("id % 2 = 1").select(F.when(named, F.concat(head, "value")).otherwise(F.col("value")).alias("match"), "value", F.when(told & (beside != 1), F.concat(innocent, F.lit(" "))).otherwise(F.concat(plain, F.lit(" "))).alias("before"), F.when(told & (beside > 0), verdict).otherwise(follows).alias("after"), F.col("label").cast("double").alias("label"))

    digits = lambda lo, hi, salt: cut(F.translate(digest(salt), "abcdef", "135790"), size(lo, hi, salt))
    own = lambda salt: choose(["hunter", "tiger", "dragon", "monkey", "orange", "window", "river", "summer", "shadow", "pass", "secret", "blue"], salt)
    leet = lambda salt: F.initcap(F.translate(own(salt), "eaos", "3405"))
    sign = lambda salt: choose([*"!#@?,;:$%&*-_. "], salt)
    short = [F.concat(own(51), digits(1, 5, 52)), F.concat(leet(53), F.initcap(own(54)), digits(1, 4, 55)), F.concat(cut(alnum("s"), size(4, 9, 56)), sign(57), cut(alnum("t"), size(2, 8, 58))), cut(alnum("r"), size(6, 20, 59)), F.concat(F.initcap(own(60)), sign(61), digits(2, 5, 62)), cut(digest("e"), size(8, 33, 63))]
    prose = lambda salt: choose(["required", "missing", "invalid", "see", "below", "yes", "no", "the", "expired", "reset", "blue", "information", "understanding", "knowledge", "principles", "maison", "Haus", "der", "que", "casa", "letters", "unknown", "hidden"], salt)
    apart = lambda *salts: F.concat_ws(" ", *map(prose, salts))
    placeholder = choose(["changeme", "your_password_here", "your-token", "password", "secret", "token", "pass", "xxxxxx", "********", "...", "<token>", "<password>", "{{password}}", "$PASSWORD", "${DB_PASS}", "%s", "null", "None", "true", "false", "undefined", "os.environ", "getpass()", "example"], 71)
    plain_number = choose(["0", "1", "12", "80", "8080", "512", "2048", "2020", "3.5", "10:30", "100%", "4,096"], 72)
    person = choose(["John", "Maria", "Smith", "Anna", "Peter", "Müller", "Dupont", "García"], 73)
    # Values of no secret: half placeholders, else prose, names, numbers; in quotes also several words.
    open_value = of([placeholder, placeholder, prose(74), prose(75), person, plain_number, F.concat(prose(76), choose([".", "!", "?", ")", "-x", "_id", ":", "()"], 77))], 78)
    quoted_value = of([open_value, open_value, apart(81, 82), apart(83, 84, 85), F.initcap(apart(86, 87, 88, 89))], 90)
    strict, loose = ["password", "passwd", "pwd", "passphrase", "secret", "Password", "PASSWORD"], ["token", "api_key", "access-key", "client_secret", "auth_token", "db_password", "authorization", "password2"]
    alike = ["author", "secretary", "tokens", "authority", "authors", "token_count", "passwords", "secrets"]
    sign_of = choose(["=", " = ", ": ", ":", " => ", " := ", "     = ", "      : "], 91)
    strictly, loosely = F.concat(choose(strict, 92), sign_of), F.concat(choose([*strict, *loose], 93), sign_of)
    quote = choose(["\"", "'"], 94)
    pem = lambda body: F.concat(F.lit("-----BEGIN "), choose(["", "RSA ", "EC ", "OPENSSH "], 95), F.lit("PRIVATE KEY-----\n"), body, F.lit("\n-----END PRIVATE KEY-----"))
    body = F.concat_ws("\n", *(cut(b64(f"m{k}"), F.lit(64)) for k in range(4)), cut(b64("n"), size(4, 30, 96)))
    scheme = choose(["Authorization: Bearer ", "Authorization: Basic ", "Bearer ", "Basic ", "auth = \"Bearer "], 97)
    user = F.concat(F.lit("://"), choose(["admin", "user", "root", "", "app"], 98), F.lit(":"))
    token = of([cut(b64("o"), size(12, 60, 99)), cut(alnum("u"), size(10, 44, 100)), cut(digest("f"), size(16, 65, 101)), F.regexp_replace(F.base64(F.concat_ws(":", own(102), short[0]).cast("binary")), r"\s", "")], 103)
    secret = of(short, 104)
    scratch = Scratch(spark, "secret-training")
    parts = {"strictly": strictly, "loosely": loosely, "quote": quote, "body": pem(body), "hollow": pem(choose(["...", "xxxxxxxx", "your key here", "<key>", "MII..."], 106)), "scheme": scheme, "user": user, "token": token, "secret": secret, "open_value": open_value, "quoted_value": quoted_value}
    ids = scratch.write(spark.range(rows).where("id % 2 = 0").select("id", *(c.alias(n) for n, c in parts.items())), "parts")
    strictly, loosely, quote, body, hollow, scheme, user, token, secret, open_value, quoted_value = map(F.col, parts)
    # (head, value) by kind: a secret, then what only looks like one.
    pairs = [
        ((F.lit(""), body), (F.lit(""), hollow)),
        ((user, F.regexp_replace(secret, r"[\s,;]", "-")), (user, F.regexp_replace(open_value, r"[<>\s]", ""))),
        ((scheme, token), (scheme, open_value)),
        ((F.concat(loosely, quote), secret), (F.concat(choose([*strict, *loose, *alike], 107), sign_of, quote), quoted_value)),
        ((loosely, F.regexp_replace(secret, r"[\s,;]", "-")), (F.concat(choose([*strict, *loose, *alike], 108), sign_of), F.regexp_replace(open_value, r"[<>\s]", ""))),
        ((F.concat(strictly, quote), digits(4, 11, 105)), (F.concat(choose(alike, 109), sign_of), of([plain_number, digits(1, 6, 110)], 111))),
        ((F.concat(loosely, quote), F.concat(F.lit("db"), user, F.regexp_replace(secret, r"[\s,;]", "-"), F.lit("@host/db"))), (F.concat(loosely, quote), F.concat(F.lit("https://host/"), prose(112)))),
    ]
    kind = pick(len(pairs), 113)
    side = lambda secrets, part: functools.reduce(lambda rest, k: F.when(kind == k, pairs[k][secrets][part]).otherwise(rest), range(1, len(pairs)), pairs[0][secrets][part])
    sides = scratch.write(ids.select("id", *(side(k, part).alias(f"{n}{k}") for k in (0, 1) for part, n in enumerate(("head", "value")))), "sides")
    made = sides.select(*(F.when(label == 1, F.col(f"{n}0")).otherwise(F.col(f"{n}1")).alias(n) for n in ("head", "value")), F.concat(plain, F.lit(" ")).alias("before"), follows.alias("after"), label.cast("double").alias("label"))
    return long.union(made.select(F.concat("head", "value").alias("match"), "value", "before", "after", "label"))


def train_forest(spark: SparkSession) -> list[dict]:
    """The trees of a random forest, as nested dicts: feature, threshold, left, right, or the share of secrets."""
    names = list(features(F.struct(*(F.lit("").alias(n) for n in ("match", "value", "before", "after")))))
    # In steps: all expressions at once are more code than one method can hold.
    scratch = Scratch(spark, "secret-training")
    rows = scratch.write(training_findings(spark), "findings")
    one = F.struct("match", "value", "before", "after")
    table = rows.select("label", *(c.alias(n) for n, c in features(one).items()))
    table = scratch.write(table, "features").coalesce(1)  # TRAINING_ROWS rows, passed over for each level of the trees
    table = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, subsamplingRate=0.8).fit(table)

    def tree(node) -> dict:
        if node.subtreeDepth() == 0:
            counts = node.impurityStats().stats()
            return {"p": counts[1] / (counts[0] + counts[1])}
        split = node.split()
        return {"feature": names[split.featureIndex()], "threshold": split.threshold(), "left": tree(node.leftChild()), "right": tree(node.rightChild())}

    return [tree(t._call_java("rootNode")) for t in model.trees]


def forest_score(trees: list[dict], f: Column) -> Column:
    """The mean share of secrets over the trees, for a struct of features."""

    def case(node: dict) -> Column:
        if "p" in node:
            return F.lit(float(node["p"]))
        return F.when(f[node["feature"]] <= node["threshold"], case(node["left"])).otherwise(case(node["right"]))

    return functools.reduce(lambda a, b: a + b, map(case, trees)) / len(trees)


def scan(docs: DataFrame, threshold: float = 0.5, text: str = "text", into: str = "findings") -> DataFrame:
    """``docs`` with an array of struct(start, end, value, match, score, secret) of all candidates, in text order.

    Offsets are code points of the value, end exclusive; ``secret`` is the forest's verdict. A null or empty text has no
    candidates; a very long one is scanned whole. Any other column is passed on. The forest is fitted once and kept in the
    shared folder.
    """
    trees = fitted(docs.sparkSession, "secret-forest", lambda spark: {"trees": train_forest(spark)}, VERSION)["trees"]
    judged = lambda c: F.element_at(F.transform(F.array(F.struct(*(x.alias(n) for n, x in features(c).items()))), lambda f: forest_score(trees, f)), 1)
    scored = F.transform(candidates(F.col(text)), lambda c: F.struct(c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"), c["value"].alias("value"), c["match"].alias("match"), judged(c).alias("score")))
    return docs.withColumn(into, F.transform(scored, lambda c: F.struct(c["start"], c["end"], c["value"], c["match"], c["score"], (c["score"] >= threshold).alias("secret"))))


def redacted(text: Column, findings: Column, mask: str = MASK) -> Column:
    """The text with every value judged a secret replaced by ``mask``."""
    secrets = F.filter(findings, lambda c: c["secret"])
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"), c["end"].alias("at"))
    done = F.aggregate(secrets, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(secrets) == 0, text).otherwise(done)


def secret_findings(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per candidate in ``docs(doc_id, text, ...)``: doc_id, start, end, value_sha256, n_chars, score, secret.

    The value itself stays out of the result. A document without candidates has no row; a null doc_id stays null;
    repeated rows repeat their findings; other columns are ignored; an empty table gives an empty result.
    """
    found = scan(docs.select("doc_id", "text"), threshold).select("doc_id", F.explode("findings").alias("c"))
    return found.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.sha2("c.value", 256).alias("value_sha256"), F.length("c.value").cast("long").alias("n_chars"), F.round("c.score", 6).alias("score"), F.col("c.secret").alias("secret"))
