"""Queries whose tables pass through files: what a reader finds in a folder, and what a writer leaves in one.

Each lays its rows out as the files that the reader takes, in the shared folder; a file a row is the sources' own layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat, markdown
from corpusmill.functions import text as T
from corpusmill.operators import control, conversations, dataset, lexicon, vectors
from corpusmill.sources import files, sinks
from corpusmill.storage import appended, fresh_path, written

from . import corpus, sessions
from .registry import ORACLE, Tables, query

#: Files of a folder of reviews, about: the driver lists and plans those of one folder at a time.
FILES = 1 << 15


def filed(rows: DataFrame, value: Column, name: str, by: tuple[str, ...] = ()) -> str:
    """A folder with the value of each row as a file of its own, in folders of the columns by; tasks move their files themselves."""
    folder = fresh_path(rows.sparkSession, name)
    writer = rows.select(*by, value.alias("value")).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.partitionBy(*by) if by else writer).text(folder)
    return folder


def part(path: str, column: str) -> Column:
    """The value of column in a path that partitionBy() made."""
    return F.regexp_extract(path, f"(?:^|/){column}=([^/]*)/", 1)


@query("""SELECT 'd' || item_id % 4 AS dir, md5(text || chr(10)) AS text_md5, (strlen(text) + 1)::bigint AS bytes FROM benchmark WHERE item_id % 4 <> 3""")
def q47_markdown_walk(t: Tables) -> DataFrame:
    """Items as files in four folders, one of which the walk is told to leave out."""
    own = t("benchmark").withColumn("dir", F.concat(F.lit("d"), (F.col("item_id") % 4).cast("string")))
    found = files.markdown(own.sparkSession, filed(own, F.col("text"), "markdown", ("dir",)), (*files.EXCLUDED, "dir=d3"), "*.txt")
    return found.select(part("path", "dir").alias("dir"), F.md5("text").alias("text_md5"), F.col("bytes").cast("long").alias("bytes"))


_REVIEWS = "reviewed AS (SELECT l.doc_id, l.quality, d.text, l.doc_id % 11 = 0 AS broken FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def reviewed(t: Tables) -> list[str]:
    """Folders of review files: an approved or refused question each, one without an answer, and files that aren't JSON."""
    label, text, none = t("labels"), F.col("text"), F.lit("")
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(label.count() / FILES))))
    d = label.join(t("documents").select("doc_id", "text"), "doc_id").withColumn("shelf", shelf)
    name = F.col("doc_id").cast("string")
    answers = F.array(F.struct(F.concat(F.lit("short "), name).alias("answer")), F.struct(text.alias("answer")))
    one = F.struct(F.concat(F.lit("What does "), name, F.lit(" say?")).alias("question"), answers.alias("answers"), F.lit(5).alias("rating"), F.when(F.col("doc_id") % 2 == 0, text).otherwise(none).alias("synthesis_answer"), (F.col("quality") == 1).alias("approved"))
    two = F.struct(F.lit("unanswered?").alias("question"), F.slice(answers, 1, 0).alias("answers"), F.lit(4).alias("rating"), none.alias("synthesis_answer"), F.lit(True).alias("approved"))
    review = F.to_json(F.struct(F.concat(F.lit("c"), name).alias("context_id"), name.alias("source_doc"), text.alias("context"), F.array(one, two).alias("questions")))
    return files.folders(d.sparkSession, filed(d, F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("{"), name)).otherwise(review), "reviews", ("shelf",)))


@query(f"""WITH {_REVIEWS} SELECT 'c' || doc_id AS context_id, md5('Question: What does ' || doc_id || ' say?' || chr(10) || 'Answer: ' || CASE WHEN doc_id % 2 = 0 AND stripped <> '' THEN stripped ELSE 'short ' || doc_id END) AS text_md5
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped FROM reviewed) WHERE NOT broken AND quality = 1""")
def q48_review_files(t: Tables) -> DataFrame:
    spark = t("labels").sparkSession
    told = (dataset.reviewed_pairs(files.reviews(spark, folder, "*.txt"))[0] for folder in reviewed(t))
    return appended((dataset.pair_records(pairs, plain=True).select("context_id", F.md5("text").alias("text_md5")) for pairs in told), "pairs")


@query(f"""WITH {_REVIEWS} SELECT count(*) FILTER (WHERE broken)::bigint AS rejected, count(*) FILTER (WHERE NOT broken)::bigint AS read, (2 * count(*) FILTER (WHERE NOT broken) - count(*) FILTER (WHERE NOT broken AND quality = 1))::bigint AS skipped FROM reviewed""")
def q48_rejected_files(t: Tables) -> DataFrame:
    spark = t("labels").sparkSession
    texts = appended((files.review_texts(spark, folder, "*.txt") for folder in reviewed(t)), "texts")  # files are opened once
    rows = files.parsed_reviews(texts)
    bad = files.rejected(texts).agg(F.count(F.lit(1)).alias("rejected"))
    return bad.crossJoin(rows.agg(F.count(F.lit(1)).alias("read"))).crossJoin(dataset.reviewed_pairs(rows)[1])


@query("""SELECT 'item ' || item_id AS title, CASE WHEN item_id % 2 = 0 THEN item_id / 7.0::double ELSE 0 END AS zipf_avg, 'alpha' || item_id || CASE WHEN item_id % 3 = 0 THEN '' ELSE ',beta' END AS rare_terms, 0.5::double AS rarity_pos
FROM benchmark WHERE item_id % 5 <> 0""")
def q49_signature_files(t: Tables) -> DataFrame:
    """Signatures with missing fields, terms that aren't strings, and files that aren't signatures."""
    name = F.col("item_id").cast("string")
    zipf = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('"zipf_avg": '), (F.col("item_id") / 7.0).cast("string"), F.lit(", "))).otherwise("")
    terms = F.concat(F.lit('"rare_terms": ["alpha'), name, F.lit('", '), F.when(F.col("item_id") % 3 == 0, "17").otherwise('"beta"'), F.lit("]"))
    own = F.concat(F.lit('{"title": "item '), name, F.lit('", '), zipf, terms, F.lit(', "rarity_pos": 0.5}'))
    folder = filed(t("benchmark"), F.when(F.col("item_id") % 5 == 0, "{broken").otherwise(own), "signatures")
    found = files.signatures(t("benchmark").sparkSession, folder, pattern="*.txt")
    return found.select("title", "zipf_avg", F.array_join("rare_terms", ",").alias("rare_terms"), "rarity_pos")


@query(f"""WITH {sessions._SAID},
opened AS (SELECT *, max((role <> 'user')::int) OVER (PARTITION BY conv_id ORDER BY pos) AS open FROM said)
SELECT conv_id, count(*)::bigint AS turns, max((role IN ('user', 'assistant'))::int)::bigint AS character_records, count(*) FILTER (WHERE role = 'user' AND open = 1)::bigint AS painter_records, false AS failed
FROM opened WHERE conv_id % 10 <> 0 GROUP BY conv_id
UNION ALL SELECT DISTINCT conv_id, 0, 0, 0, true FROM conversations WHERE conv_id % 10 = 0""")
def q50_chat_log_manifest(t: Tables) -> DataFrame:
    """Chat logs as files, in order of their messages' keys, read again; logs without messages are listed as failed."""
    spark, folder = t("conversations").sparkSession, fresh_path(t("conversations").sparkSession, "chatlogs")
    listed = sessions.hosted(t).groupBy(F.col("conv_id").alias("conv")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", "host"))).alias("rows"))
    key = lambda x, i: F.concat(F.lit("m"), i.cast("string"))
    messages = F.map_from_arrays(F.transform("rows", key), F.transform("rows", lambda x: F.struct(x["text"].alias("extracted"), x["host"].alias("host"))))
    listed.select("conv", F.when(F.col("conv") % 10 != 0, messages).alias("messages")).write.partitionBy("conv").json(folder)
    said = conversations.turns(files.chatlogs(spark, folder, skip_bad=True))
    counts = conversations.manifest(said, conversations.character_records(said), conversations.painter_records(said))
    told = counts.select(part("conv_id", "conv").cast("long").alias("conv_id"), "turns", "character_records", "painter_records", F.lit(False).alias("failed"))
    nothing = [F.lit(0).cast("long")] * 3
    return told.union(files.rejected_chatlogs(spark, folder).select(part("path", "conv").cast("long"), *nothing, F.lit(True)))


@query(f"SELECT doc_id, split, md5(text) AS text_md5 FROM ({ORACLE['q10_train_valid_split']}) JOIN documents USING (doc_id)")
def q51_training_files(t: Tables) -> DataFrame:
    """Training records written twice, the second time in place of the first, and read again."""
    own, folder = t("documents").select("doc_id", "text"), fresh_path(t("documents").sparkSession, "training")
    for _ in range(2):
        sinks.jsonl(dataset.split(own, F.col("doc_id")), folder)
    found = own.sparkSession.read.schema("doc_id long, text string, split string").json(folder)
    return found.select("doc_id", "split", F.md5("text").alias("text_md5"))


@query(f"SELECT conv_id, turn, reward, 2::bigint AS copies FROM ({ORACLE['q43_high_reward']})")
def q52_anchor_append(t: Tables) -> DataFrame:
    high, folder = written(sessions.q43_high_reward(t), "high"), fresh_path(t("conversations").sparkSession, "anchors")
    for _ in range(2):
        sinks.anchors(high, folder)
    return high.sparkSession.read.schema(high.schema).json(folder).groupBy("conv_id", "turn", "reward").agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT event_type AS path, count(*)::bigint AS commits, sum(CASE WHEN user_id % 7 = 0 THEN 0 ELSE event_id % 17 END)::bigint AS additions, sum(CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id % 5 END)::bigint AS deletions,
       arg_max(md5(event_id::varchar), {'t': ts, 'h': md5(event_id::varchar)}) AS last_modified_commit FROM events GROUP BY event_type""")
def q53_git_totals(t: Tables) -> DataFrame:
    """Events as a git log, binary files among them, read again and summed by file."""
    e = t("events")
    number = lambda c: F.when(F.col("user_id") % 7 == 0, "-").otherwise(c.cast("string"))
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    line = F.concat_ws("\t", number(F.col("event_id") % 17), number(F.col("user_id") % 5), F.col("event_type"))
    folder = fresh_path(e.sparkSession, "log")
    e.select(F.concat(F.md5(F.col("event_id").cast("string")), F.lit("\x1f"), at, F.lit("\n\n"), line, F.lit("\n"))).write.option("lineSep", "\x1e").text(folder)
    return control.totals(files.commits(e.sparkSession, folder), ["path"]).select("path", "commits", "additions", "deletions", "last_modified_commit")


@query("SELECT event_id, (user_id % 5)::double AS elapsed, round(CASE WHEN user_id % 5 > 0 THEN event_id / (user_id % 5)::double ELSE 0 END, 6) AS token_throughput FROM events")
def q54_throughput(t: Tables) -> DataFrame:
    runs = t("events").select("event_id", F.lit(100.0).alias("start_time"), (F.lit(100.0) + F.col("user_id") % 5).alias("end_time"), F.col("event_id").alias("output_tokens"))
    return control.throughput(runs).select("event_id", "elapsed", F.round("token_throughput", 6).alias("token_throughput"))


@query(f"WITH {corpus.LEXICON}, {corpus.RARE} SELECT doc_id FROM rare")
def q55_without_thin(t: Tables) -> DataFrame:
    return lexicon.without_thin(t("documents"), corpus.profiles(t)).select("doc_id")


#: What a sentence becomes by the first digit of its digest, and the paragraphs that come of it (\u0001: an element begins).
_FORMS = {
    "0": ("'- ' || replace(b, ', ', ',' || chr(10) || '- ')", "[]"),
    "1": ("'> ' || b", "[]"),
    "2": ("'## ' || b", "[]"),
    "3": ("'1. ' || b", "[]"),
    "4": ("b || ' [link](http://x/y \"t\") tail ' || b", "[b || ' ' || chr(1) || ' tail ' || b]"),
    "5": ("'```py' || chr(10) || chr(10) || b || chr(10) || chr(10) || '```'", "[]"),
    "6": ("'See **bold** and `a*b [x](y)` in _it_ <span>x</span> a_b_c: ' || b", "['See bold and a*b [x](y) in it x a_b_c: ' || b]"),
    "7": ("b || ' &amp; <br> more'", "[b || ' & ' || chr(1)]"),
    "8": ("'Two' || chr(10) || '===' || chr(10) || chr(10) || b", "['Two ===', b]"),
    "9": ("'| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'", "['| a | b | |---|---| | 1 | 2 |']"),
    "a": ("'- - -' || chr(10) || chr(10) || b || chr(10) || chr(10) || '![i](u) x'", "[b]"),
    "b": ("'[id]: http://x' || chr(10) || chr(10) || b || ' [ID] rest'", "[b || ' ' || chr(1)]"),
    "c": ("'<div>' || b || chr(10) || chr(10) || b || '</div> after'", "['after']"),
    "d": ("'<p class=\"q\">' || b || ' <em>x</em> <b>y</b></p>'", "[replace(b, '***', chr(2)) || ' x ']"),
}


@query(f"""WITH sentences AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '. '), lambda b: trim(regexp_replace(b, '[ \t\n]+', ' ', 'g'))), lambda b: b <> '')) AS b,
         unnest(range(len(list_filter(list_transform(string_split(text, '. '), lambda b: trim(regexp_replace(b, '[ \t\n]+', ' ', 'g'))), lambda b: b <> '')))) AS i FROM documents),
formed AS (SELECT doc_id, i, b, CASE substr(md5(b), 1, 1) {" ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in _FORMS.items())} ELSE CASE WHEN regexp_matches(b, '^(#|[0-9]+[.] |[*+-] |>)') THEN [] ELSE [b] END END AS ps FROM sentences),
bare AS (SELECT doc_id, i, list_transform(ps, lambda p: replace(string_split(regexp_replace(p, '[*][*][*](.+?)[*][*][*]', '\\1', 'g'), chr(1))[1], chr(2), '***')) AS ps FROM formed),
whole AS (SELECT doc_id, flatten(list(ps ORDER BY i)) AS ps FROM bare GROUP BY doc_id)
SELECT doc_id, coalesce(len(ps), 0)::bigint AS n, md5(coalesce(array_to_string(ps, chr(10)), '')) AS text_md5 FROM documents LEFT JOIN whole USING (doc_id) WHERE text IS NOT NULL""")
def q56_paragraphs_markdown(t: Tables) -> DataFrame:
    """Documents whose sentences are lists, quotes, headings, tables, code, HTML, links and plain ones, wrapped at commas."""
    whole = F.transform(F.split("text", r"\. "), lambda b: F.trim(F.regexp_replace(b, r"[ \t\n]+", " ")))
    own = t("documents").filter("text is not null")
    sentence = own.select("doc_id", F.posexplode(F.filter(whole, lambda b: b != "")).alias("i", "b"))
    plain = "replace(b, ', ', ',' || char(10) || ' ')"
    form = F.expr(f"CASE substr(md5(b), 1, 1) {' '.join(f"WHEN '{k}' THEN {v[0].replace('chr(', 'char(')}" for k, v in _FORMS.items())} ELSE {plain} END")
    text = sentence.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", form.alias("f")))), lambda x: x["f"]), "\n \n").alias("text"))
    found = own.select("doc_id").join(text, "doc_id", "left").select("doc_id", markdown.paragraphs(F.coalesce("text", F.lit(""))).alias("ps"))
    return found.select("doc_id", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", "\n")).alias("text_md5"))


@query("""WITH cut AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS ws FROM documents),
sized AS (SELECT doc_id, ws, len(ws) AS n FROM cut),
placed AS (SELECT doc_id, ws, n, unnest(range(0, (n // 90 + 1)::bigint)) AS i FROM sized)
SELECT doc_id, (i + 1)::bigint AS chunk, md5('Document: ' || doc_id || chr(10) || 'Chunk ' || (i + 1) || '/' || count(*) OVER (PARTITION BY doc_id) || chr(10) || '---' || chr(10) || array_to_string(ws[i * 90 + 1 : i * 90 + 100], '')) AS text_md5
FROM placed WHERE n > 0 AND (i = 0 OR (i - 1) * 90 + 100 < n)""")
def q57_token_chunks(t: Tables) -> DataFrame:
    """Chunks of tokens that decode to the text itself: words and what stands between them."""
    found = dataset.chunk_records(t("documents"), 100, 10, encode=T.tokens, decode=lambda x: F.array_join(x, ""))
    return found.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text_md5"))


@query("""SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'Assistant: ') AS prompt_md5, md5(string_agg('- ' || text, chr(10) ORDER BY turn)) AS bullets_md5
FROM conversations GROUP BY conv_id""")
def q58_plain_prompts(t: Tables) -> DataFrame:
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("rows"))
    return rows.select("conv_id", F.md5(chat.transcript(F.col("rows"))).alias("prompt_md5"), F.md5(chat.bullets(F.transform("rows", lambda r: r["content"]))).alias("bullets_md5"))


@query(f"""WITH RECURSIVE {ORACLE['q28_clusters'].split('WITH RECURSIVE', 1)[1].rsplit('SELECT id, CASE', 1)[0].rstrip()},
sizes AS (SELECT cluster FROM found GROUP BY cluster HAVING count(*) >= 15)
SELECT (SELECT count(*) FROM vs)::bigint AS nodes, (SELECT count(*) FROM sizes)::bigint AS clusters, (SELECT count(*) FROM near)::bigint AS edges""")
def q59_topology_counts(t: Tables) -> DataFrame:
    own, near = sessions.embedded(t), sessions.nearest(t)
    return vectors.topology(near, vectors.clusters(near, own, vectors.cut(near)), vectors.projected(own))[2]
