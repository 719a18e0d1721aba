"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import payloads as J
from ..functions import text as X
from ..functions.language import (
    cosine_similarity,
    detect_language,
    letter_counts,
    letter_frequency,
    load_profiles,
)
from . import frames as T
from .frames import sql_text, with_sql
from .registry import query

QUESTION = "Question: {query}\nAnswer: {answer}\nReply as {{json}}."
REPLY = "{{P}} {priority_level}/{topic}/{intent}: {issue_description} | {context}"


@query(
    "render_prompt",
    with_sql("pairs")
    + f""" SELECT ticket_id, replace(replace({sql_text(QUESTION)}, '{{query}}',
           body || ' {{answer}}'), '{{answer}}', answer) AS prompt FROM answered""",
)
def render_prompt(spark, tables):
    """The query ends in a hole, which the next replacement fills as well."""
    rows = T.answered_tickets(spark, tables)
    holes = {"query": F.concat("body", F.lit(" {answer}")), "answer": F.col("answer")}
    return rows.select("ticket_id", X.render_prompt(QUESTION, holes).alias("prompt"))


@query(
    "render_prompt_format",
    """SELECT doc_id, '{P} ' || coalesce(CASE WHEN toxic = 1 THEN 'HIGH' END, 'UNKNOWN')
           || '/other/question: ' || text || ' {context}' || ' | ' || source AS prompt
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def render_prompt_format(spark, tables):
    """The text ends in what looks like a hole and has to stay."""
    rows = T.scan(spark, tables, "documents").join(T.scan(spark, tables, "labels"), "doc_id", "left")
    missing = F.lit(None).cast("string")
    prompt = X.render_prompt_format(
        REPLY,
        {
            "priority_level": F.when(F.col("toxic") == 1, "HIGH"),
            "topic": missing,
            "intent": missing,
            "issue_description": F.concat("text", F.lit(" {context}")),
            "context": F.col("source"),
        },
        {
            "priority_level": V.DEFAULT_PRIORITY,
            "topic": V.DEFAULT_TOPIC,
            "intent": V.DEFAULT_INTENT,
        },
    )
    return rows.select("doc_id", prompt.alias("prompt"))


@query(
    "strip_prefixes",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'Cleaned Answer: ' || text ELSE text END
           AS text FROM conversations""",
)
def strip_prefixes(spark, tables):
    """Two prefixes in a row for assistants, the wrong order for system turns, blanks for users."""
    rows = T.scan(spark, tables, "conversations")
    dirty = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("Cleaned Answer:\n Cleaned: "), "text"))
        .when(F.col("role") == "system", F.concat(F.lit("Cleaned: Cleaned Answer: "), "text"))
        .otherwise(F.concat(F.lit(" \n "), "text", F.lit("\t ")))
    )
    return rows.select("conv_id", "turn", X.strip_prefixes(dirty).alias("text"))


@query(
    "normalize_label",
    """SELECT event_id, upper(event_type) AS label, event_type IN ('click', 'error') AS valid
    FROM events""",
)
def normalize_label(spark, tables):
    label = X.normalize_label(F.concat(F.lit(" \n"), "event_type", F.lit(" ")))
    return T.scan(spark, tables, "events").select(
        "event_id", label.alias("label"), label.isin("CLICK", "ERROR").alias("valid")
    )


@query(
    "normalize_priority",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
           WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM orders""",
)
def normalize_priority(spark, tables):
    return T.scan(spark, tables, "orders").select(
        "o_orderkey", X.normalize_priority(F.lower("o_orderpriority")).alias("priority")
    )


@query("extract_json_object", "SELECT event_id, props AS found FROM events")
def extract_json_object(spark, tables):
    prose = F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))
    return T.scan(spark, tables, "events").select(
        "event_id", X.extract_json_object(prose).alias("found")
    )


@query(
    "parse_topic_intent",
    """SELECT event_id,
           CASE event_type WHEN 'click' THEN 'topic ' || k WHEN 'view' THEN k ELSE 'other' END AS topic,
           CASE event_type WHEN 'click' THEN 'intent {' || event_id || '}' WHEN 'purchase' THEN 'on "' || k || '"'
                ELSE 'question' END AS intent
    FROM (SELECT *, props->>'k' AS k FROM events)""",
)
def parse_topic_intent(spark, tables):
    """The number in a row's properties, wrapped in prose, as a number, quoted, in broken quotes, bare."""
    k = F.get_json_object("props", "$.k")
    intent = F.concat(F.lit("intent {"), "event_id", F.lit("}"))
    whole = F.to_json(F.struct(F.concat(F.lit("topic "), k).alias("topic"), intent.alias("intent")))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Here: "), whole, F.lit(" ok")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"topic": '), k, F.lit("}")))
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit('{"topic": null, "intent": "on \\"'), k, F.lit('\\""}')),
        )
        .when(F.col("event_type") == "signup", F.concat(F.lit("{'topic': '"), k, F.lit("'}")))
        .otherwise(k)
    )
    found = J.parse_topic_intent(raw)
    return T.scan(spark, tables, "events").select(
        "event_id", found["topic"].alias("topic"), found["intent"].alias("intent")
    )


@query(
    "parse_judge_response",
    f"""WITH j AS (SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events)
    SELECT event_id,
           CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k::DOUBLE / 100 ELSE 0.0 END AS score,
           CASE event_type WHEN 'click' THEN 'because ' || k WHEN 'view' THEN '' WHEN 'purchase' THEN 'x'
                WHEN 'signup' THEN '{V.PARSE_FAILED}' ELSE '{V.INVALID_RESPONSE}' END AS explanation,
           event_type IN ('click', 'view', 'purchase') AS parse_ok
    FROM j""",
)
def parse_judge_response(spark, tables):
    """Fenced, bare fence with a text score, wrapped in prose, broken, null."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    score = (k / 100).cast("string")
    raw = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit('Result:\n```json\n{"score": '), score,
                F.lit(', "explanation": "because '), k.cast("string"), F.lit('"}\n```'),
            ),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit('```\n{"score": "'), score, F.lit('"}\n```')))
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit('I say {"score": '), score, F.lit(', "explanation": "x"} and stop')),
        )
        .when(F.col("event_type") == "signup", "{score 0.5")
    )
    found = J.parse_judge_response(raw)
    return T.scan(spark, tables, "events").select(
        "event_id",
        found["score"].alias("score"),
        found["explanation"].alias("explanation"),
        found["parse_ok"].alias("parse_ok"),
    )


def agent_responses(spark, tables):
    """Documents as agent responses: English ones searched, toxic labels mark failed searches."""
    docs = T.scan(spark, tables, "documents").join(T.scan(spark, tables, "labels"), "doc_id", "left")
    searched = F.col("lang") == "en"
    no_text = F.lit(None).cast("string")
    status = F.when(F.col("toxic") == 1, "error").otherwise("success")
    use = F.struct(
        F.when(searched, V.SEARCH_TOOL).otherwise("calculator").alias("name"),
        F.col("source").alias("input"),
    )
    result = F.struct(
        F.when(searched, V.SEARCH_TOOL).otherwise("calculator").alias("name"),
        status.alias("status"),
        F.col("text").alias("content"),
    )
    none_use, none_result = F.lit(None).cast("struct<name:string,input:string>"), F.lit(None).cast(
        "struct<name:string,status:string,content:string>"
    )

    def step(kind, tool_use, tool_result, text):
        return F.struct(
            F.lit(kind).alias("type"),
            tool_use.alias("tool_use"),
            tool_result.alias("tool_result"),
            text.alias("text"),
        )

    tokens = F.struct(
        F.col("source").alias("model_name"),
        F.struct(F.col("n_chars").alias("total")).alias("input_tokens"),
        F.struct((F.col("n_chars") * 2).alias("total")).alias("output_tokens"),
    )
    response = F.struct(
        F.array(
            step("thinking", none_use, none_result, F.lit("hm")),
            step("tool_use", use, none_result, no_text),
            step("tool_result", none_use, result, no_text),
            step("text", none_use, none_result, F.col("text")),
        ).alias("content"),
        F.struct(F.struct(F.array(tokens).alias("tokens_consumed")).alias("usage")).alias("metadata"),
    )
    return docs.select("doc_id", F.to_json(response).alias("response"))


LABELLED = "FROM documents LEFT JOIN labels USING (doc_id)"


@query(
    "extract_tool_steps",
    f"""SELECT doc_id, lang = 'en' AS used_search,
           CASE WHEN lang = 'en' THEN '{V.SEARCH_TOOL}' ELSE 'calculator' END || ':' || source AS uses,
           CASE WHEN lang = 'en' THEN '{V.SEARCH_TOOL}' ELSE 'calculator' END || ':'
             || CASE WHEN toxic = 1 THEN 'error' ELSE 'success' END || ':' || length(text) AS results
    {LABELLED}""",
)
def extract_tool_steps(spark, tables):
    steps = J.extract_tool_steps(F.col("response"))
    rows = agent_responses(spark, tables).select("doc_id", steps.alias("s"))
    uses = F.transform("s.tool_uses", lambda u: F.concat_ws(":", u["name"], u["input"]))
    results = F.transform(
        "s.tool_results",
        lambda r: F.concat_ws(":", r["name"], r["status"], F.length(r["content"]).cast("string")),
    )
    return rows.select(
        "doc_id",
        F.col("s.used_search").alias("used_search"),
        F.array_join(uses, ";").alias("uses"),
        F.array_join(results, ";").alias("results"),
    )


@query(
    "extract_context",
    f"""SELECT doc_id, CASE WHEN lang = 'en' AND coalesce(toxic, 0) <> 1 THEN text
           ELSE '{V.NO_CONTEXT}' END AS context {LABELLED}""",
)
def extract_context(spark, tables):
    steps = J.extract_tool_steps(F.col("response"))
    rows = agent_responses(spark, tables).select("doc_id", steps["tool_results"].alias("r"))
    return rows.select("doc_id", J.extract_context(F.col("r")).alias("context"))


@query(
    "extract_usage",
    """SELECT doc_id, source AS agent_model, n_chars AS total_input_tokens,
           n_chars * 2 AS total_output_tokens FROM documents""",
)
def extract_usage(spark, tables):
    rows = agent_responses(spark, tables).select(
        "doc_id", J.extract_usage(F.col("response")).alias("u")
    )
    return rows.select("doc_id", "u.agent_model", "u.total_input_tokens", "u.total_output_tokens")


@query(
    "join_context",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN '{V.NO_CONTEXT_MARK}'
           ELSE replace(text, chr(10), {sql_text(V.CHUNK_SEPARATOR)}) END AS context FROM documents""",
)
def join_context(spark, tables):
    chunks = F.when(F.col("lang") != "fr", F.split("text", "\n"))
    return T.scan(spark, tables, "documents").select(
        "doc_id", J.join_context(chunks).alias("context")
    )


def _letter_sql(letter: str) -> str:
    return f"(length(lower(text)) - length(replace(lower(text), '{letter}', '')))"


COUNTED = (
    "WITH counted AS (SELECT *, ["
    + ", ".join(_letter_sql(ch) for ch in V.LETTERS)
    + "]::BIGINT[] AS counts FROM documents), shared AS (SELECT *, list_transform(counts,"
    + " lambda c: CASE WHEN list_sum(counts) = 0 THEN 0.0::DOUBLE"
    + " ELSE c::DOUBLE / list_sum(counts)::DOUBLE END) AS shares FROM counted)"
)


def _cosine_sql(profile: list[float]) -> str:
    dot = " + ".join(f"shares[{i + 1}] * {w!r}::DOUBLE" for i, w in enumerate(profile))
    norm = " + ".join(f"shares[{i + 1}] * shares[{i + 1}]" for i in range(len(profile)))
    fixed = sum(w * w for w in profile) ** 0.5
    return f"coalesce(({dot}) / nullif(sqrt({norm}) * {fixed!r}::DOUBLE, 0), 0)"


SIMS = (
    COUNTED
    + f", sims AS (SELECT doc_id, {_cosine_sql(V.LETTER_SHARE_EN)} AS sim_en,"
    + f" {_cosine_sql(V.LETTER_SHARE_DE)} AS sim_de FROM shared)"
)


@query(
    "letter_frequency",
    COUNTED
    + ", flat AS (SELECT doc_id, unnest(shares) AS share, unnest(["
    + ", ".join(f"'{ch}'" for ch in V.LETTERS)
    + "]) AS letter FROM shared) SELECT doc_id, letter, round(share, 6) AS share FROM flat",
)
def letter_frequency_query(spark, tables):
    shares = (
        T.scan(spark, tables, "documents")
        .select("doc_id", letter_counts(F.col("text")).alias("counts"))
        .select("doc_id", letter_frequency(F.col("counts")).alias("shares"))
    )
    letters = F.array(*[F.lit(ch) for ch in V.LETTERS])
    return shares.select("doc_id", F.explode_outer(F.arrays_zip("shares", letters.alias("letters"))).alias("z")).select(
        "doc_id", F.col("z.letters").alias("letter"), F.round("z.shares", 6).alias("share")
    )


@query(
    "cosine_similarity",
    SIMS + " SELECT doc_id, round(sim_en, 6) AS sim_en, round(sim_de, 6) AS sim_de FROM sims",
)
def cosine_similarity_query(spark, tables):
    shares = (
        T.scan(spark, tables, "documents")
        .select("doc_id", letter_counts(F.col("text")).alias("counts"))
        .select("doc_id", letter_frequency(F.col("counts")).alias("shares"))
    )
    return shares.select(
        "doc_id",
        F.round(cosine_similarity(F.col("shares"), V.LETTER_SHARE_EN), 6).alias("sim_en"),
        F.round(cosine_similarity(F.col("shares"), V.LETTER_SHARE_DE), 6).alias("sim_de"),
    )


DETECTED = SIMS + """, detected AS (
    SELECT doc_id, CASE WHEN sim_en > sim_de THEN 'en' ELSE 'de' END AS language FROM sims)"""


@query("detect_language", DETECTED + " SELECT * FROM detected")
def detect_language_query(spark, tables):
    return detect_language(T.scan(spark, tables, "documents")).select("doc_id", "language")


@query(
    "load_profiles",
    "WITH counted AS (SELECT lang AS language, "
    + ", ".join(f"sum({_letter_sql(ch)}) AS c{i}" for i, ch in enumerate(V.LETTERS))
    + " FROM documents WHERE lang IN ('de', 'en') GROUP BY lang), profile AS ("
    + " UNION ALL ".join(
        f"SELECT '{lang}' AS language, '{ch}' AS letter, {share!r}::DOUBLE AS share, {i} AS i"
        for lang, shares in V.LETTER_PROFILES.items()
        for i, (ch, share) in enumerate(zip(V.LETTERS, shares))
    )
    + """), flat AS (SELECT language, [c0"""
    + "".join(f", c{i}" for i in range(1, len(V.LETTERS)))
    + """]::DOUBLE[] AS cs FROM counted)
    SELECT language, letter, round(share, 6) AS expected_share,
           round(cs[i + 1] / list_sum(cs), 6) AS observed_share
    FROM profile JOIN flat USING (language)""",
)
def load_profiles_query(spark, tables):
    """The profile next to the letter shares of the documents of its language."""
    counted = T.scan(spark, tables, "documents").select(
        F.col("lang").alias("language"), letter_counts(F.col("text")).alias("counts")
    )
    sums = counted.groupBy("language").agg(
        *[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(len(V.LETTERS))]
    )
    letters = F.array(
        *[F.struct(F.lit(ch).alias("letter"), F.col(f"c{i}").alias("n")) for i, ch in enumerate(V.LETTERS)]
    )
    total = sum((F.col(f"c{i}") for i in range(1, len(V.LETTERS))), F.col("c0"))
    observed = sums.select("language", total.alias("total"), F.explode(letters).alias("l")).select(
        "language", "l.letter", (F.col("l.n") / F.col("total")).alias("observed_share")
    )
    # The profiles are 60 fixed rows.
    return observed.join(F.broadcast(load_profiles(spark)), ["language", "letter"]).select(
        "language",
        "letter",
        F.round("share", 6).alias("expected_share"),
        F.round("observed_share", 6).alias("observed_share"),
    )


@query(
    "epoch_ms_to_ts",
    """SELECT event_id, CASE WHEN event_type <> 'error'
           THEN date_trunc('millisecond', ts)::TIMESTAMP END AS ts FROM events""",
)
def epoch_ms_to_ts(spark, tables):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = T.scan(spark, tables, "events")
    return rows.select(
        "event_id", X.epoch_ms_to_ts(F.when(F.col("event_type") != "error", ms)).alias("ts")
    )


@query("null_zero_parent", "SELECT conv_id, turn, nullif(turn, 0) AS parent_id FROM conversations")
def null_zero_parent(spark, tables):
    return T.scan(spark, tables, "conversations").select(
        "conv_id", "turn", X.null_zero_parent(F.col("turn")).alias("parent_id")
    )


@query(
    "short_id",
    "SELECT conv_id, turn, substr(md5(conv_id || '-' || turn), 1, 8) AS short_id FROM conversations",
)
def short_id(spark, tables):
    key = F.md5(F.concat_ws("-", "conv_id", "turn"))
    return T.scan(spark, tables, "conversations").select(
        "conv_id", "turn", X.short_id(key).alias("short_id")
    )


@query("format_minute", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def format_minute(spark, tables):
    return T.scan(spark, tables, "events").select(
        "event_id", X.format_minute(F.col("ts")).alias("minute")
    )


@query("clip_text", "SELECT doc_id, substr(text, 1, 100) AS clipped FROM documents")
def clip_text(spark, tables):
    return T.scan(spark, tables, "documents").select(
        "doc_id", X.clip_text(F.col("text")).alias("clipped")
    )


@query(
    "concat_embed_text",
    with_sql("tickets")
    + " SELECT ticket_id, concat_ws(' ', subject, body, answer) AS text FROM tickets",
)
def concat_embed_text(spark, tables):
    text = X.concat_embed_text(F.col("subject"), F.col("body"), F.col("answer"))
    return T.tickets(spark, tables).select("ticket_id", text.alias("text"))
