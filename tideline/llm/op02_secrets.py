"""Secret scan by multipart credential linking.

A pattern for each form finds the parts of credentials in a text: access identifiers,
secrets and endpoints, each an interval of characters; a secret may lie inside an
endpoint (a URL's password or query parameter). The parts are joined as intervals within
their scope (a document's text): a secret is linked with the nearest identifier and the nearest
endpoint at most ``window`` characters away. Secrets of a strong form (assigned to a
telling name, or with an issuer's prefix) are reported in any case; weak ones (a bare
hexadecimal run, a short password) only when an identifier or an endpoint co-occurs.

The texts are scanned by JVM expressions, once a form: matches are set off by a mark that
no text has, and the lengths of the pieces between marks add up to offsets. So no Python
is needed and SQL can say the same. Only parts are shuffled. The interval join buckets
positions by the window, so its cost follows the parts near each other, not the square of
a document's parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import ready, small

WINDOW = 300

#: What the parts look like; each is sought on its own, so parts may overlap. Only constructs on
#: which Java and RE2 agree. A quote, in JSON within a string an escaped one, may close the name
#: before the separator.
QUOTE = r"(?:\\?[\"'])?"
ASSIGN = rf"{QUOTE}[ \t]{{0,3}}[=:][ \t]{{0,3}}{QUOTE}"
SECRET_NAME = r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)"
#: A URL's user and password, and the name and value of a query parameter.
USER, PASSWORD = r"[^ \t\r\n\"'<>/?#@:]", r"[^ \t\r\n\"'<>/?#]"
PATTERNS = {
    "aws_id": r"A[KS]IA[0-9A-Z]{16}",
    "issued": r"ghp_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "assigned": rf"{SECRET_NAME}{ASSIGN}[0-9A-Za-z+/_.~!@#%^&*-]{{6,}}",
    "bearer": r"(?i:bearer)[ \t]{1,3}[0-9A-Za-z._~+/-]{16,}",
    "identifier": rf"(?i:key[_-]?id|client[_-]?id|user(?:name)?|login|account|app[_-]?id){ASSIGN}[0-9A-Za-z._@+-]{{2,}}",
    "url": r"(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^ \t\r\n\"'<>]{4,}",
    "userinfo": rf"://{USER}*:{PASSWORD}+@",
    "user": rf"://{USER}+:{PASSWORD}+@",
    "query": rf"[?&][0-9A-Za-z_.-]{{0,40}}{SECRET_NAME}=[^ \t\r\n\"'<>&#;]{{6,}}",
    "address": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "email": r"[0-9A-Za-z._+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+",
    "hex": r"[0-9a-fA-F]{32,}",
}
#: What of a match stands before the value, and after it.
LEAD = {"assigned": rf"^[A-Za-z_-]+{ASSIGN}", "identifier": rf"^[A-Za-z_-]+{ASSIGN}", "userinfo": rf"^://{USER}*:", "user": "^://", "query": "^[^=]+=",
        "bearer": r"^[A-Za-z]+[ \t]+"}
TAIL = {"userinfo": "@$", "user": rf":{PASSWORD}+@$"}
#: No part of the form is without this text.
NEEDS = {"jwt": "eyJ", "private_key": "-----BEGIN", "url": "://", "email": "@", "userinfo": "://", "user": "://"}
#: No part is without one of these.
HINT = r"[=:@0-9]|----|ghp_|xox|sk-|A[KS]IA|AIza|eyJ|(?i:bearer)|[a-fA-F]{32}"
#: Sets off matches; in texts it is read as a blank.
MARK = "\x01"
#: An assigned value of fewer characters, or of letters alone, is weak.
STRONG_CHARS = 16
#: Of equal intervals the first form stays.
SECRETS = ("private_key", "query", "userinfo", "assigned", "issued", "jwt", "bearer", "hex")
#: Secrets in any case, and secrets if long and of letters and digits.
STRONG, MIXED = ("issued", "private_key", "userinfo", "jwt"), ("assigned", "query", "bearer")
#: What else would be a part inside these is a piece of the secret.
HARD = ("query", "userinfo", "assigned", "issued", "jwt", "bearer")
IDENTIFIERS = ("aws_id", "identifier", "email", "user")


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, scope, start, stop, form, value): each part of each text, in characters from 0.
    scope is the text's MD5: a part is of a text, not of all texts of its doc_id."""
    hit = docs.filter(F.col("text").rlike(HINT)).select("doc_id", F.md5("text").alias("scope"), F.translate("text", MARK, " ").alias("text"))
    none = F.array().cast("array<struct<n:int,whole:string>>")

    def cut(form):
        pattern = PATTERNS[form]
        pieces = F.split(F.regexp_replace("text", pattern, f"{MARK}$0{MARK}"), MARK, -1)
        made = F.transform(pieces, lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, x).alias("whole")))
        return F.struct(F.lit(form).alias("form"), F.when(F.col("text").contains(NEEDS[form]), made).otherwise(none).alias("p") if form in NEEDS else made.alias("p"))

    each = hit.select("doc_id", "scope", F.explode(F.array(*[cut(f) for f in PATTERNS])).alias("c")).filter("size(c.p) > 1")
    # Equal rows once.
    each = each.select("doc_id", "scope", "c.form", F.posexplode("c.p").alias("at", "p")).select("doc_id", "scope", "form", "at", "p.*").distinct()
    stop = F.sum("n").over(W.partitionBy("doc_id", "scope", "form").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    found = each.withColumn("stop", stop).filter("at % 2 = 1")

    def by_form(table):
        out = F.when(F.lit(False), "")
        for name, pattern in table.items():
            out = out.when(F.col("form") == name, F.regexp_extract("whole", pattern, 0))
        return F.length(out.otherwise(F.lit("")))

    return (found.withColumn("_l", by_form(LEAD)).withColumn("_t", by_form(TAIL))
            .withColumn("value", F.expr("substring(whole, _l + 1, length(whole) - _l - _t)"))
            .withColumn("stop", F.col("stop") - F.col("_t"))
            .select("doc_id", "scope", (F.col("stop") - F.length("value")).alias("start"), "stop", "form", "value").distinct())


def judged(found: DataFrame) -> DataFrame:
    """parts with ``role`` (secret, identifier, endpoint) and ``strong``,
    less those that are a piece of another: of secrets one within another goes, if the other
    is as strong; what only looks like an identifier or address inside a secret goes, and a
    hexadecimal run that is an identifier."""
    form, scope = F.col("form"), ("doc_id", "scope")
    role = (F.when(form.isin(*SECRETS), "secret").when(form.isin(*IDENTIFIERS), "identifier").otherwise("endpoint"))
    strong = form.isin(*STRONG) | (form.isin(*MIXED) & (F.length("value") >= STRONG_CHARS) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    order = F.array_position(F.array(*[F.lit(x) for x in SECRETS]), form)
    made = found.withColumn("role", role).withColumn("strong", strong).withColumn("_o", order)
    # A query parameter ends at the next one; the same value as an assigned one doesn't.
    made = made.withColumn("_query", F.max(form == "query").over(W.partitionBy(*scope, "start"))).filter(~(F.col("_query") & (form == "assigned")))
    so_far = W.partitionBy(*scope).orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    secret = F.col("role") == "secret"
    before = W.partitionBy(*scope).orderBy("start", F.desc("stop"), "_o").rowsBetween(W.unboundedPreceding, -1)
    # A weak and a strong form of one interval: the strong one's strength holds for both.
    made = made.withColumn("strong", F.max(F.when(secret, F.col("strong")).otherwise(F.lit(False))).over(W.partitionBy(*scope, "start", "stop")))
    within = F.when(F.col("strong"), F.max(F.when(secret & F.col("strong"), F.col("stop"))).over(before)).otherwise(
        F.max(F.when(secret, F.col("stop"))).over(before)) >= F.col("stop")
    inside = F.max(F.when(form.isin(*HARD), F.col("stop"))).over(so_far) > F.col("start")
    named = F.max(F.when(F.col("role") == "identifier", F.col("stop"))).over(so_far) >= F.col("stop")
    gone = (F.when(secret, within | ((form == "hex") & named)).when(form.isin("url", "user"), False).otherwise(inside))
    return (made.withColumn("_gone", F.coalesce(gone, F.lit(False))).filter("NOT _gone").drop("_gone", "_o", "_query")
            .withColumn("strong", F.col("strong") & (F.col("role") == "secret")))


def linked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``link`` with each row's scope."""
    if window < 1:
        raise ValueError("window must be at least 1")
    ready(docs.sparkSession)
    known = judged(parts(docs).checkpoint()).checkpoint()
    secrets = known.filter("role = 'secret'")
    others = known.filter("role <> 'secret'")
    near = others.select("scope", F.col("doc_id").alias("o_id"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("role").alias("o_role"), F.col("value").alias("o_value"),
                         F.explode(F.sequence(F.floor((F.col("start") - window) / window), F.floor((F.col("stop") + window) / window))).alias("b"))
    # A secret looks into the bucket of its start; one longer than a bucket looks into all that it covers.
    wide = secrets.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(F.col("stop") / window))))
    gap = F.greatest(F.col("o_start") - F.col("stop"), F.col("start") - F.col("o_stop"), F.lit(0))
    same = (wide["scope"] == near["scope"]) & (wide["b"] == near["b"]) & wide["doc_id"].eqNullSafe(near["o_id"])
    joined = (wide.join(near.select("*", F.lit(1).alias("_n")), same, "left").select(wide["*"], "o_start", "o_stop", "o_value", "o_role")
              .withColumn("gap", gap).withColumn("o_role", F.when(F.col("gap") <= window, F.col("o_role"))))
    nearest = F.struct("gap", "o_start", "o_value")
    # The path of a URL often has a hash; a bare run needs an endpoint other than the one it is in.
    apart = (F.col("form") != "hex") | (F.col("o_start") >= F.col("stop")) | (F.col("o_stop") <= F.col("start"))
    made = joined.groupBy("doc_id", "scope", "start", "stop", "form", "value", "strong").agg(
        F.min(F.when(F.col("o_role") == "identifier", nearest)).alias("i"),
        F.min(F.when(F.col("o_role") == "endpoint", nearest)).alias("e"),
        F.max(F.when(F.col("o_role") == "endpoint", apart)).alias("at"))
    return (made.filter(F.col("strong") | F.col("i").isNotNull() | F.col("at"))
            .select("scope", "doc_id", "start", "stop", "form", "value", "strong",
                    F.col("i.o_value").alias("identifier"), F.col("e.o_value").alias("endpoint")))


def link(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, stop, form, value, strong, identifier, endpoint), a row per reported secret.

    identifier and endpoint are the nearest of the row's own text within ``window`` characters
    (between the intervals), the first of equally near ones, or null. Null and empty
    texts have no parts; very long texts are scanned whole; equal rows (same doc_id and
    text) report once; unlike texts of one doc_id, or of rows without one, are apart; other
    columns are ignored; an empty table gives an empty result."""
    return linked(docs, window).drop("scope")


MASK = "[SECRET]"


def redact(docs: DataFrame, window: int = WINDOW, mask: str = MASK) -> DataFrame:
    """docs with every reported secret's value replaced by ``mask`` and n_chars brought up to date.

    All rows and columns stay; rows without a reported secret stay as they are, null and empty
    texts too. A row's own text decides: rows of one doc_id, or without one, don't touch each
    other, and repeated rows are masked alike. Spans that overlap share a mask. Texts of any
    length are masked whole; columns of any name are carried along; an empty table stays empty."""
    scope = ("doc_id", "scope")
    spans = linked(docs, window).select(*scope, "start", "stop").distinct()
    over = W.partitionBy(*scope).orderBy("start", "stop")
    new = F.coalesce((F.col("start") >= F.max("stop").over(over.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    spans = (spans.withColumn("_new", new).withColumn("_i", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
             .groupBy(*scope, "_i").agg(F.min("start").cast("int").alias("start"), F.max("stop").cast("int").alias("stop")))
    found = spans.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found = small(found.select(F.struct(F.col("doc_id").alias("id"), "scope", "spans").alias("_f")).checkpoint())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"))
    text, spans = F.col("_r.text"), F.col("_f.spans")
    before = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit(mask)))
    cut = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans, -1)["stop"] + 1, F.length(text)))
    made = row.join(found, F.col("_r.doc_id").eqNullSafe(F.col("_f.id")) & (F.md5(text) == F.col("_f.scope")), "left").withColumn(
        "_t", F.when(spans.isNull(), text).otherwise(cut))

    def out(c):
        own = F.col(f"_r.`{c}`")
        if c == "text":
            return F.col("_t").alias(c)
        if c == "n_chars":
            return F.when(spans.isNull(), own).otherwise(F.length("_t").cast(docs.schema[c].dataType)).alias(c)
        return own.alias(c)

    return made.select(*[out(c) for c in docs.columns])


def query(spark, sf_dir):
    from tideline.llm.common import read

    return link(read(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names(forms) -> str:
    return ", ".join(f"'{x}'" for x in forms)


def _lengths(table) -> str:
    return "CASE form " + " ".join(f"WHEN '{n}' THEN length(regexp_extract(whole, {_sql(p)}))" for n, p in table.items()) + " ELSE 0 END"


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, scope, '{n}' AS form, regexp_extract_all(text, {_sql(p)}) AS m, string_split_regex(text, {_sql(p)}) AS gaps FROM h WHERE regexp_matches(text, {_sql(p)})"
    for n, p in PATTERNS.items())
ORACLE = f"""
WITH h AS (SELECT DISTINCT doc_id, md5(text) AS scope, translate(text, chr(1), ' ') AS text FROM documents WHERE text IS NOT NULL),
m AS ({_MATCHES}),
x AS (SELECT doc_id, scope, form, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM m),
y AS (SELECT doc_id, scope, form, m[i] AS whole,
        (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))))::BIGINT AS stop FROM x),
z AS (SELECT *, {_lengths(LEAD)} AS l, {_lengths(TAIL)} AS t FROM y),
v AS (SELECT DISTINCT doc_id, scope, form, (stop - t)::BIGINT AS stop, substr(whole, l + 1, length(whole) - l - t) AS value FROM z),
p AS (SELECT doc_id, scope, form, (stop - length(value))::BIGINT AS start, stop, value,
        CASE WHEN form IN ({_names(SECRETS)}) THEN 'secret' WHEN form IN ({_names(IDENTIFIERS)}) THEN 'identifier' ELSE 'endpoint' END AS role,
        form IN ({_names(STRONG)}) OR (form IN ({_names(MIXED)}) AND length(value) >= {STRONG_CHARS}
          AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')) AS hard,
        list_position([{_names(SECRETS)}], form) AS o FROM v),
q AS (SELECT *, bool_or(form = 'query') OVER (PARTITION BY doc_id, scope, start) AS q FROM p),
s AS (SELECT *, bool_or(role = 'secret' AND hard) OVER (PARTITION BY doc_id, scope, start, stop) AS firm FROM q WHERE NOT (q AND form = 'assigned')),
u AS (SELECT *, max(CASE WHEN role = 'secret' AND firm THEN stop END) OVER before AS firm_stop, max(CASE WHEN role = 'secret' THEN stop END) OVER before AS any_stop,
        max(CASE WHEN form IN ({_names(HARD)}) THEN stop END) OVER so_far AS hard_stop, max(CASE WHEN role = 'identifier' THEN stop END) OVER so_far AS named_stop FROM s
      WINDOW before AS (PARTITION BY doc_id, scope ORDER BY start, stop DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             so_far AS (PARTITION BY doc_id, scope ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, firm AND role = 'secret' AS strong FROM u WHERE NOT coalesce(CASE
        WHEN role = 'secret' THEN coalesce(CASE WHEN firm THEN firm_stop ELSE any_stop END >= stop, false) OR (form = 'hex' AND coalesce(named_stop >= stop, false))
        WHEN form IN ('url', 'user') THEN false ELSE hard_stop > start END, false)),
j AS (SELECT a.*, b.role AS o_role, b.value AS o_value, b.start AS o_start, b.stop AS o_stop, greatest(b.start - a.stop, a.start - b.stop, 0) AS gap
      FROM (SELECT * FROM k WHERE role = 'secret') a LEFT JOIN (SELECT * FROM k WHERE role <> 'secret') b
        ON a.scope = b.scope AND a.doc_id IS NOT DISTINCT FROM b.doc_id AND greatest(b.start - a.stop, a.start - b.stop, 0) <= {WINDOW}),
l AS (SELECT doc_id, scope, start, stop, form, value, strong,
        arg_min(o_value, (gap, o_start, o_value)) FILTER (o_role = 'identifier') AS identifier,
        arg_min(o_value, (gap, o_start, o_value)) FILTER (o_role = 'endpoint') AS endpoint,
        bool_or(form <> 'hex' OR o_start >= stop OR o_stop <= start) FILTER (o_role = 'endpoint') AS apart
      FROM j GROUP BY ALL)
SELECT doc_id, start, stop, form, value, strong, identifier, endpoint FROM l WHERE strong OR identifier IS NOT NULL OR apart
"""
