"""Queries over conversations, completions, embeddings and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat, sentiment
from corpusmill.functions import text as T
from corpusmill.operators import control, conversations, dataset, density, generation, vectors
from corpusmill.storage import written

from .registry import Tables, query

_SAID = """
hosted AS (SELECT conv_id, turn, CASE WHEN (role <> 'assistant') <> (turn = 2) THEN 'web' END AS host, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
kept AS (SELECT * FROM hosted WHERE text <> '' AND (host IS NOT NULL OR length(text) >= 20)),
roles AS (
  SELECT conv_id, turn, text, CASE WHEN host IS NULL THEN 'assistant' WHEN row_number() OVER (PARTITION BY conv_id, host IS NULL ORDER BY turn) = 1 THEN 'system' ELSE 'user' END AS role FROM kept),
marks AS (SELECT *, role = 'system' OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS fresh FROM roles),
islands AS (SELECT *, sum(fresh::int) OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM marks),
said AS (SELECT conv_id, pos, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM islands GROUP BY ALL)"""


def hosted(t: Tables) -> DataFrame:
    """conversations with a host for all but the assistant; the second turn has the other side's, so that equal roles meet."""
    return t("conversations").withColumn("host", F.when((F.col("role") != "assistant") != (F.col("turn") == 2), "web"))


def said(t: Tables) -> DataFrame:
    return conversations.turns(hosted(t))


@query("""SELECT conv_id, count(*)::bigint AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (WHERE role IN ('user', 'assistant')) > 0""")
def q11_character_records(t: Tables) -> DataFrame:
    turns = t("conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    found = conversations.character_records(turns)
    return found.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("messages_md5"))


@query("""WITH firsts AS (SELECT conv_id, min(turn) AS one FROM conversations WHERE role <> 'user' GROUP BY conv_id),
opened AS (SELECT c.conv_id, turn, role, text FROM conversations c JOIN firsts f ON c.conv_id = f.conv_id AND c.turn >= f.one),
seen AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN 'user' WHEN 'user' THEN 'assistant' ELSE role END || ':' || text AS line FROM opened)
SELECT a.conv_id, a.turn AS pos, count(*)::bigint AS n, md5(string_agg(b.line, chr(10) ORDER BY b.turn)) AS messages_md5
FROM seen a JOIN seen b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'user' GROUP BY ALL""")
def q12_painter_records(t: Tables) -> DataFrame:
    turns = t("conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    found = conversations.painter_records(turns)
    return found.select("conv_id", "pos", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("messages_md5"))


@query(f"WITH {_SAID} SELECT conv_id, pos::bigint AS pos, role, md5(content) AS content_md5 FROM said")
def q13_role_assignment_merge(t: Tables) -> DataFrame:
    return said(t).select("conv_id", F.col("pos").cast("long").alias("pos"), "role", F.md5("content").alias("content_md5"))


_DIRTY = "chr(8220) || replace(replace(text, '.', chr(8230) || chr(226) || chr(128) || chr(153)), ', ', chr(160) || chr(8212) || '\\n') || chr(8221)"
_PAIRS = "[[chr(8212), '--'], [chr(8211), '-'], [chr(8220), '\"'], [chr(8221), '\"'], [chr(8216), ''''], [chr(8217), ''''], [chr(8230), '...'], [chr(160), ' '], [chr(226) || chr(128) || chr(153), ''''], [chr(226) || chr(128) || chr(148), '--'], ['\\n', chr(10)]]"


@query(f"SELECT conv_id, turn, md5(list_reduce(list_transform({_PAIRS}, lambda p: [p[1], p[2]]), lambda acc, p: [replace(acc[1], p[1], p[2])], [{_DIRTY}])[1]) AS text_md5 FROM conversations")
def q14_punctuation_repair(t: Tables) -> DataFrame:
    dots = F.replace("text", F.lit("."), F.lit("…â\u0080\u0099"))
    dirty = F.concat(F.lit("“"), F.replace(dots, F.lit(", "), F.lit(" —\\n")), F.lit("”"))
    return t("conversations").select("conv_id", "turn", F.md5(T.repaired(dirty)).alias("text_md5"))


_COMPLETION = "replace(replace(text, '. ', '? Q>2. '), ', ', ' q> ')"
_QUESTIONS = """list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(c, '[Qq]?>'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: contains(x, '?')),
  lambda x: regexp_replace(regexp_replace(split_part(x, '?', 1) || '?', '^\\s*\\d+[.)]?\\s*', ''), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 1)"""


def completion() -> Column:
    return F.replace(F.replace("text", F.lit(". "), F.lit("? Q>2. ")), F.lit(", "), F.lit(" q> "))


@query(f"""WITH cs AS (SELECT doc_id, {_COMPLETION} AS c FROM documents), qs AS (SELECT doc_id, {_QUESTIONS} AS q FROM cs)
SELECT doc_id, len(q)::bigint AS n, len(list_distinct(q))::bigint AS n_distinct, md5(array_to_string(list_sort(list_distinct(q)), chr(10))) AS questions_md5 FROM qs""")
def q20_question_parse(t: Tables) -> DataFrame:
    found = t("documents").select("doc_id", T.questions(completion()).alias("q"))
    return found.select("doc_id", F.size("q").cast("long").alias("n"), F.size(F.array_distinct("q")).cast("long").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.array_distinct("q")), "\n")).alias("questions_md5"))


@query(f"""WITH cs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pass, {_COMPLETION} AS c FROM conversations),
qs AS (SELECT conv_id, pass, {_QUESTIONS} AS q FROM cs WHERE pass <= 10),
firsts AS (SELECT conv_id, item, min(pass) AS pass FROM (SELECT conv_id, pass, unnest(q) AS item FROM qs) GROUP BY ALL),
stops AS (SELECT conv_id, coalesce(min(pass) FILTER (WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id = qs.conv_id AND f.pass = qs.pass)), max(pass)) AS attempts FROM qs GROUP BY conv_id)
SELECT s.conv_id, attempts::bigint AS attempts, count(item)::bigint AS n, coalesce(string_agg(md5(item), ',' ORDER BY md5(item)), '') AS found
FROM stops s LEFT JOIN firsts f ON f.conv_id = s.conv_id AND f.pass <= attempts GROUP BY ALL""")
def q21_convergence(t: Tables) -> DataFrame:
    found = generation.converged(t("conversations"), "conv_id", "turn", T.questions(completion()), generation.QUESTION_ATTEMPTS)
    return found.select("conv_id", F.col("attempts").cast("long").alias("attempts"), F.size("found").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("found", F.md5)), ",").alias("found"))


@query("""WITH found AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, '. ', chr(10) || '## '), '##\\s*([^\\n]+)', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '\\p{L}$')) AS ts FROM documents),
each AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS place FROM found),
firsts AS (SELECT doc_id, term, min(place) AS place FROM each GROUP BY ALL)
SELECT d.doc_id, count(term)::bigint AS n, md5(coalesce(string_agg(term, ',' ORDER BY place), '')) AS terms_md5 FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def q40_listed_terms(t: Tables) -> DataFrame:
    found = t("documents").select("doc_id", T.listed_terms(F.replace("text", F.lit(". "), F.lit("\n## "))).alias("ts"))
    return found.select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", ",")).alias("terms_md5"))


_REPLIES = """replies AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no verdict' ELSE 'Well. rating: ' || (quality * 3 + doc_id % 3) || chr(10) || 'Synthesis: ' || text END AS reply FROM labels JOIN documents USING (doc_id)),
rated AS (SELECT doc_id, coalesce(nullif(regexp_extract(reply, '(?i)RATING:\\s*([0-5])', 1), '')::int, 0) AS rating, regexp_replace(regexp_extract(reply, '(?is)SYNTHESIS:\\s*(.+)', 1), '^\\s+|\\s+$', '', 'g') AS synthesis FROM replies)"""


def replies(t: Tables) -> DataFrame:
    own = t("labels").join(t("documents").select("doc_id", "text"), "doc_id")
    text = F.concat(F.lit("Well. rating: "), (F.col("quality") * 3 + F.col("doc_id") % 3).cast("string"), F.lit("\nSynthesis: "), F.col("text"))
    return generation.graded(own.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "no verdict").otherwise(text).alias("reply")))


@query(f"WITH {_REPLIES} SELECT doc_id, rating, md5(synthesis) AS synthesis_md5, rating >= 4 AS approved FROM rated")
def q22_rating_parse_approve(t: Tables) -> DataFrame:
    return replies(t).select("doc_id", "rating", F.md5("synthesis_answer").alias("synthesis_md5"), "approved")


def curated(t: Tables) -> DataFrame:
    """A review a document: its graded reply to one question, and the first line as a candidate answer."""
    own = replies(t).select("doc_id", "approved", "synthesis_answer")
    question = F.struct(F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"), F.array(F.lit("It says something.")).alias("answers"), "approved", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("synthesis_answer")).alias("synthesis_answer"))
    return own.select("doc_id", F.array(question).alias("questions"))


def _prompt(template: str, **values: str) -> str:
    """SQL of a template whose {names} are replaced by expressions."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_ASKED = "'What does document ' || doc_id || ' in {context} say?'"


@query(f"""WITH own AS (SELECT doc_id, text, {_ASKED} AS question, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:doc_id % 4] AS answers FROM documents)
SELECT doc_id, 'question' AS kind, md5({_prompt(chat.QUESTION_PROMPT, context="text")}) AS prompt_md5 FROM own
UNION ALL SELECT doc_id, 'answer', md5({_prompt(chat.ANSWER_PROMPT, question="question", context="text")}) FROM own
UNION ALL SELECT doc_id, 'curation', md5({_prompt(chat.CURATION_PROMPT, context="text", question="question", answers="CASE WHEN len(answers) > 0 THEN array_to_string(list_transform(answers, lambda x: '- ' || x), chr(10)) ELSE '- (none)' END")}) FROM own""")
def q64_model_prompts(t: Tables) -> DataFrame:
    """The prompts for questions, answers and grades on every whole document; questions have braces, answers are up to three lines."""
    question = F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" in {context} say?"))
    answers = F.slice(F.filter(F.split("text", "\n"), lambda x: x != ""), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    own = t("documents").select("doc_id", "text", F.col("text").alias("context"), question.alias("question"), answers.alias("answers"))
    made = {"question": generation.question_prompts(own, "doc_id"), "answer": generation.answer_prompts(own, "doc_id"), "curation": generation.curation_prompts(own, "doc_id")}
    told = [df.select("doc_id", F.lit(kind).alias("kind"), F.md5("prompt").alias("prompt_md5")) for kind, df in made.items()]
    return told[0].union(told[1]).union(told[2])


@query(f"""WITH {_REPLIES}
SELECT doc_id, 'What does document ' || doc_id || ' say?' AS question, CASE WHEN doc_id % 4 = 0 OR synthesis = '' THEN 'It says something.' ELSE synthesis END AS answer,
       (SELECT count(*) FROM rated WHERE rating < 4)::bigint AS skipped
FROM rated WHERE rating >= 4""")
def q23_curated_pairs(t: Tables) -> DataFrame:
    pairs, skipped = dataset.reviewed_pairs(curated(t), "doc_id")
    return pairs.crossJoin(F.broadcast(skipped))


@query(f"WITH {_REPLIES} SELECT count(DISTINCT doc_id)::bigint AS contexts, count(*)::bigint AS questions_graded, count(*) FILTER (WHERE rating >= 4)::bigint AS approved FROM rated")
def q42_curation_report(t: Tables) -> DataFrame:
    return generation.curation_report(replies(t), "doc_id")


@query("""WITH cs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pass, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS item FROM conversations),
qs AS (SELECT * FROM cs WHERE pass <= 5),
firsts AS (SELECT conv_id, item, min(pass) AS pass FROM qs WHERE item <> '' GROUP BY ALL),
stops AS (SELECT conv_id, coalesce(min(pass) FILTER (WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id = qs.conv_id AND f.pass = qs.pass)), max(pass)) AS attempts FROM qs GROUP BY conv_id)
SELECT s.conv_id, attempts::bigint AS attempts, count(item)::bigint AS n, coalesce(string_agg(md5(item), ',' ORDER BY md5(item)), '') AS found
FROM stops s LEFT JOIN firsts f ON f.conv_id = s.conv_id AND f.pass <= attempts GROUP BY ALL""")
def q41_answer_convergence(t: Tables) -> DataFrame:
    found = generation.converged(t("conversations"), "conv_id", "turn", generation.answers(F.col("text")), generation.ANSWER_ATTEMPTS)
    return found.select("conv_id", F.col("attempts").cast("long").alias("attempts"), F.size("found").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("found", F.md5)), ",").alias("found"))


#: Put in the place of words by the first digit of their digest, so that every rule meets its words.
STAGED = {"0": "not", "1": "VERY", "2": "but", "3": "isn't", "4": "slightly", "5": "never so", "6": "least", "7": "no", "8": "kind of", "9": "yeah right", "a": "without doubt"}


def staged(t: Tables) -> DataFrame:
    """Conversations in which words with some digests are negations, degree words and phrases, or shout."""
    digit = lambda w, i: F.substring(F.md5(w), i, 1)

    def said(w: Column) -> Column:
        out = F.when((digit(w, 2) > "3") & w.rlike("^[A-Za-z.,]+$"), F.when(digit(w, 1) == "b", F.upper(w)).when(digit(w, 1) == "c", F.concat(w, F.lit("!"))).when(digit(w, 1) == "d", F.concat(w, F.lit("?"))))
        return F.coalesce(F.when(digit(w, 2) > "3", F.coalesce(*(F.when(digit(w, 1) == k, F.lit(v)) for k, v in STAGED.items()))), out, w)

    return t("conversations").withColumn("text", F.array_join(F.transform(F.split("text", " "), said), " "))


def valences(said: DataFrame) -> DataFrame:
    """A lexicon of a third of the words, with valences between -4 and 4 from their digests."""
    own = said.select(F.explode(sentiment.spoken(F.col("text"))).alias("word")).distinct().filter(F.substring(F.md5("word"), 3, 1) < "5")
    return own.select("word", (F.conv(F.substring(F.md5("word"), 4, 10), 16, 10).cast("double") / (1 << 40) * 8 - 4).alias("valence"))


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _chosen(word: str, values: dict[str, float], other: str) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in values.items()) + f" ELSE {other} END"


def _lagged(back: int) -> str:
    """The change of v by the word so many places before."""
    so = f"WHEN (l{back} = 'never' AND l{back - 1} IN ('so', 'this')) {"OR l1 IN ('so', 'this')" if back == 3 else ""} THEN x * 1.25" if back > 1 else ""
    doubt = f"WHEN l{back} = 'without' AND 'doubt' IN ({', '.join(f'l{b}' for b in range(1, back))}) THEN x" if back > 1 else ""
    degree = f"(CASE WHEN v < 0 THEN -d{back} ELSE d{back} END + CASE WHEN d{back} <> 0 AND c{back} AND loud THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END) * {(1.0, 0.95, 0.9)[back - 1]}::double"
    negated = f"l{back} IN ({_listed(sorted(sentiment.NEGATIONS))}) OR contains(l{back}, 'n''t')"
    return f"SELECT * EXCLUDE (v, x), CASE WHEN l{back} IS NULL OR k{back} THEN v {so} {doubt} WHEN {negated} THEN x * -0.74 ELSE x END AS v FROM (SELECT *, v + coalesce({degree}, 0) AS x FROM s{back - 1})"


_LEX = "substr(md5({0}), 3, 1) < '5'"
_VALENCE = "('0x' || substr(md5(low), 4, 10))::bigint / 1099511627776.0::double * 8 - 4"
_TRIMMED = "trim(w, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')"
_PLAIN = f"CASE WHEN length({_TRIMMED}) <= 2 THEN w ELSE {_TRIMMED} END"
_REWARDS = f"""WITH said AS (
  SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: coalesce(
    CASE WHEN substr(md5(w), 2, 1) > '3' THEN CASE substr(md5(w), 1, 1) {" ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in STAGED.items())} END END,
    CASE WHEN substr(md5(w), 2, 1) > '3' AND regexp_matches(w, '^[A-Za-z.,]+$') THEN CASE substr(md5(w), 1, 1) WHEN 'b' THEN upper(w) WHEN 'c' THEN w || '!' WHEN 'd' THEN w || '?' END END, w)), ' ') AS text
  FROM conversations),
cut AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM said)),
bare AS (SELECT conv_id, turn, i, n, {_PLAIN} AS w FROM cut),
word AS (SELECT *, lower(w) AS low, upper(w) = w AND lower(w) <> w AS caps, {_LEX.format("lower(w)")} AS known, coalesce({_chosen("lower(w)", sentiment.DEGREES, "0")}, 0) AS degree FROM bare),
told AS (
  SELECT *, {", ".join(f"lag(low, {b}) OVER o AS l{b}, lag(known, {b}) OVER o AS k{b}, lag(caps, {b}) OVER o AS c{b}, lag(degree, {b}) OVER o AS d{b}" for b in (1, 2, 3))}, lead(low) OVER o AS n1, lead(low, 2) OVER o AS n2, lead(known) OVER o AS kn1,
         sum(caps::int) OVER p BETWEEN 1 AND n - 1 AS loud, min(CASE WHEN low = 'but' THEN i END) OVER p AS but
  FROM word WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i), p AS (PARTITION BY conv_id, turn)),
s00 AS (
  SELECT *, CASE WHEN coalesce(l1 = 'no' OR l2 = 'no' OR (l3 = 'no' AND l1 IN ('or', 'nor')), false) THEN ({_VALENCE}) * -0.74 WHEN low = 'no' AND kn1 THEN 0 ELSE {_VALENCE} END AS v
  FROM told WHERE known AND degree = 0 AND NOT coalesce(low = 'kind' AND n1 = 'of', false)),
s0 AS (SELECT * EXCLUDE (v), CASE WHEN loud AND caps THEN v + CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE v END AS v FROM s00),
s1 AS ({_lagged(1)}),
s2 AS ({_lagged(2)}),
s3 AS ({_lagged(3)}),
phrased AS (
  SELECT * EXCLUDE (v), CASE WHEN l3 IS NULL OR k3 THEN v ELSE
    {_chosen("low || ' ' || n1 || ' ' || n2", sentiment.PHRASES, _chosen("low || ' ' || n1", sentiment.PHRASES, " ".join(["coalesce(" + ", ".join(_chosen(x, sentiment.PHRASES, "NULL") for x in ("l1 || ' ' || low", "l2 || ' ' || l1 || ' ' || low", "l2 || ' ' || l1", "l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2")) + ", v)"])))}
    + {" + ".join(_chosen(x, {k: v for k, v in sentiment.DEGREES.items() if " " in k}, "0") for x in ("l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2", "l2 || ' ' || l1"))} END AS v FROM s3),
least_ AS (SELECT conv_id, turn, i, CASE WHEN l1 = 'least' AND NOT {_LEX.format("'least'")} AND NOT coalesce(l2 IN ('at', 'very'), false) THEN v * -0.74 ELSE v END AS v FROM phrased),
felt AS (SELECT t.conv_id, t.turn, coalesce(v * CASE WHEN t.i < but THEN 0.5 WHEN t.i > but THEN 1.5 ELSE 1 END, 0) AS v FROM told t LEFT JOIN least_ USING (conv_id, turn, i)),
sums AS (SELECT conv_id, turn, sum(v) AS s, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS up, coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS down, count(*) FILTER (WHERE v = 0) AS flat FROM felt GROUP BY ALL),
marks AS (
  SELECT conv_id, turn, text, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::double + CASE WHEN q < 2 THEN 0 WHEN q <= 3 THEN q * 0.18::double ELSE 0.96 END AS marks
  FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS q FROM said)),
charged AS (
  SELECT conv_id, turn, least(0.5 * abs(round(c / sqrt(c * c + 15), 4)) + 0.5 * (1 - round(flat / (up + down + flat + CASE WHEN up <> down THEN marks ELSE 0 END), 3)), 1) AS charge
  FROM (SELECT *, s + sign(s) * marks AS c FROM sums JOIN marks USING (conv_id, turn))),
novel AS (SELECT conv_id, turn, text, CASE WHEN row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) = 1 THEN 0.2 ELSE 0 END AS novelty FROM said)
SELECT conv_id, turn, round(CASE WHEN length(text) > 0 THEN least(least(length(text) / 200.0::double, 1.0) * 0.4 + coalesce(charge, 0.5) * 0.4 + novelty, 1.0) ELSE 0 END, 6) AS reward
FROM novel LEFT JOIN charged USING (conv_id, turn)"""


@query(_REWARDS)
def q25_reward_score(t: Tables) -> DataFrame:
    said = staged(t)
    found = conversations.rewards(said, valences(said), ["conv_id", "turn"], ["conv_id", "turn"], "text")
    return found.select("conv_id", "turn", F.round("reward", 6).alias("reward"))


@query(f"SELECT conv_id, turn, reward FROM ({_REWARDS}) WHERE reward >= 0.6")
def q43_high_reward(t: Tables) -> DataFrame:
    return conversations.high_reward(q25_reward_score(t))


def embedded(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def nearest(t: Tables) -> DataFrame:
    return written(vectors.neighbours(embedded(t)), "neighbours")


_KNN = """
vs AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
near AS (
  SELECT source, target, distance, row_number() OVER (PARTITION BY source ORDER BY round(distance, 9), target) AS rank
  FROM (SELECT a.vec_id AS source, b.vec_id AS target, list_distance(a.v, b.v) AS distance FROM vs a JOIN vs b ON a.vec_id <> b.vec_id)
  QUALIFY rank <= 5)"""


@query(f"WITH {_KNN} SELECT source, target, round(distance, 6) AS distance, rank::int AS rank FROM near")
def q26_knn_graph(t: Tables) -> DataFrame:
    return vectors.neighbours(embedded(t)).select("source", "target", F.round("distance", 6).alias("distance"), "rank")


@query("""WITH RECURSIVE steps AS (SELECT label, vec_id, embedding::double[] AS z, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
trace AS (
  SELECT label, vec_id, i, z, list_transform(z, lambda x: 0::double) AS x, 1.0::double AS p, z AS off FROM steps WHERE i = 1
  UNION ALL
  SELECT s.label, s.vec_id, s.i, s.z, nx, (1 - (p + 0.01) / (p + 0.11)) * (p + 0.01), list_transform(list_zip(s.z, nx), lambda q: q[1] - q[2])
  FROM (SELECT *, list_transform(list_zip(x, off), lambda q: q[1] + (p + 0.01) / (p + 0.11) * q[2]) AS nx FROM trace) t JOIN steps s ON s.label = t.label AND s.i = t.i + 1)
SELECT label::varchar AS trace, vec_id AS step, round(sqrt(list_sum(list_transform(off, lambda x: x * x))), 6) AS deviation, round(sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS norm FROM trace""")
def q27_kalman_deviation(t: Tables) -> DataFrame:
    found = vectors.deviations(embedded(t), "label", "id")
    return found.select("trace", "step", F.round("deviation", 6).alias("deviation"), F.round("norm", 6).alias("norm"))


@query(f"WITH {_KNN} SELECT source AS id, round(distance, 6) AS core FROM near WHERE rank = 5")
def q28_core_distance(t: Tables) -> DataFrame:
    return vectors.core_distances(vectors.neighbours(embedded(t))).select("id", F.round("core", 6).alias("core"))


@query(f"""WITH RECURSIVE {_KNN},
cores AS (SELECT source AS id, distance AS core FROM near WHERE rank = 5),
cut AS (SELECT quantile_disc(core, 0.9) AS c FROM cores),
links AS (SELECT source AS u, target AS v FROM near JOIN cores a ON a.id = source JOIN cores b ON b.id = target, cut WHERE greatest(distance, a.core, b.core) <= c),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vs UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
found AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY cluster) >= 15 THEN cluster ELSE -1 END::bigint AS cluster FROM found""")
def q28_clusters(t: Tables) -> DataFrame:
    near = nearest(t)
    return vectors.clusters(near, embedded(t), vectors.cut(near))


@query(f"""WITH RECURSIVE {_KNN},
cores AS (SELECT source AS id, max(distance) AS core FROM near GROUP BY source),
reach AS (
  SELECT a.vec_id AS u, b.vec_id AS v, greatest(list_distance(a.v, b.v), x.core, y.core) AS w
  FROM vs a JOIN vs b ON a.vec_id <> b.vec_id JOIN cores x ON x.id = a.vec_id JOIN cores y ON y.id = b.vec_id),
one AS (SELECT min(vec_id) AS first, count(*) - 1 AS last FROM vs),
grown AS (
  SELECT 0 AS step, vec_id AS node, vec_id = first AS inside, CASE WHEN vec_id = first THEN 0 ELSE 'infinity'::double END AS w, first AS newest FROM vs, one
  UNION ALL
  SELECT step + 1, node, inside OR node = next, w, next
  FROM (SELECT *, first_value(node) OVER (ORDER BY inside, w, node) AS next FROM (
    SELECT step, node, inside, CASE WHEN inside THEN g.w ELSE least(g.w, r.w) END AS w, newest FROM grown g LEFT JOIN reach r ON r.u = g.newest AND r.v = g.node))
  WHERE step < (SELECT last FROM one)),
added AS (SELECT w FROM grown, one WHERE step = last AND node <> first)
SELECT row_number() OVER (ORDER BY w)::bigint AS place, round(w, 6) AS w FROM added""")
def q28_spanning_tree(t: Tables) -> DataFrame:
    """The lengths of the tree's edges in order: the same for every shortest tree."""
    tree = density.numbered(density.spanning_tree(embedded(t), nearest(t)), "place", "w", "u", "v")
    return tree.select((F.col("place") + 1).alias("place"), F.round("w", 6).alias("w"))


@query()
def q28_density_clusters(t: Tables) -> DataFrame:
    return density.clusters(embedded(t))


@query()
def q29_pca_projection(t: Tables) -> DataFrame:
    return vectors.projected(embedded(t))


def commands(t: Tables) -> DataFrame:
    """Commands from events: each delivered twice where the id is even, with unknown actions and missing fields among them."""
    e = t("events")
    own = e.select(
        F.col("event_id").cast("string").alias("command_id"), F.when(F.col("user_id") % 13 != 0, F.col("user_id").cast("string")).alias("dataset_id"),
        F.when(F.col("event_type") == "view", "ORCHESTRATION_ACTION_PREPARE").when(F.col("event_type") == "click", "train").when(F.col("event_type") == "purchase", "Prepare").otherwise(F.col("event_type")).alias("action"), F.col("event_id").alias("seq"),
    )
    return own.union(own.filter("cast(command_id as bigint) % 2 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))


_COMMANDS = """
once AS (
  SELECT event_id::varchar AS command_id, CASE WHEN user_id % 13 <> 0 THEN user_id::varchar END AS dataset_id,
         CASE event_type WHEN 'view' THEN 'ORCHESTRATION_ACTION_PREPARE' WHEN 'click' THEN 'train' WHEN 'purchase' THEN 'Prepare' ELSE event_type END AS action, event_id AS seq FROM events),
commands AS (SELECT * FROM once UNION ALL SELECT command_id, dataset_id, action, seq + 1000000000 FROM once WHERE seq % 2 = 0),
known AS (SELECT *, CASE replace(upper(action), 'ORCHESTRATION_ACTION_', '') WHEN 'PREPARE' THEN 'prepare' WHEN 'TRAIN' THEN 'train' END AS step FROM commands)"""


@query(f"""WITH {_COMMANDS}, firsts AS (SELECT command_id, min(seq) AS one FROM known WHERE dataset_id IS NOT NULL AND step IS NOT NULL GROUP BY command_id)
SELECT k.command_id, seq, step, CASE WHEN dataset_id IS NULL THEN 'invalid' WHEN step IS NULL THEN 'rejected' WHEN seq > one THEN 'duplicate' ELSE 'accepted' END AS status
FROM known k LEFT JOIN firsts f ON f.command_id = k.command_id""")
def q30_idempotent_commands(t: Tables) -> DataFrame:
    return control.judged(commands(t)).select("command_id", "seq", "step", "status")


@query("SELECT event_id::varchar AS command_id, event_id AS seq FROM events ORDER BY event_id DESC LIMIT 4096")
def q30_retained_window(t: Tables) -> DataFrame:
    """The latest 4096 ids: a top-k, which is the operator."""
    return control.retained(commands(t))


def event_state() -> Column:
    """A state's name for the type of an event."""
    names = {"view": "not_started", "error": "failed", "purchase": "Done", "click": "in_progress"}
    return F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()), F.col("event_type"))


@query("""SELECT user_id::varchar AS dataset_id, CASE arg_max(event_type, {'t': ts, 'i': event_id}) WHEN 'view' THEN 'QUEUED' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'IN_PROGRESS' ELSE 'UNSPECIFIED' END AS state
FROM events GROUP BY user_id""")
def q31_state_machine_latest(t: Tables) -> DataFrame:
    own = t("events").select(F.col("user_id").cast("string").alias("dataset_id"), control.wire_state(event_state()).alias("wire"), "ts", "event_id")
    return control.latest_state(own, ["dataset_id"], "wire", ["ts", "event_id"])


@query("""SELECT h::int AS hour, count(*) FILTER (WHERE event_type = 'error')::bigint AS errors, count(event_id)::bigint AS polls
FROM (SELECT unnest(range(24)) AS h) LEFT JOIN events ON hour(ts) = h GROUP BY h""")
def q32_error_hour_histogram(t: Tables) -> DataFrame:
    return control.error_hours(t("events"), F.col("event_type") == "error")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 OR props IS NULL THEN NULL ELSE json_extract(props, '$.k')::bigint END AS k, event_id % 9 = 0 OR props IS NULL AS malformed FROM events""")
def q33_malformed_events(t: Tables) -> DataFrame:
    broken = t("events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    good, bad = control.parsed_events(broken, "k bigint")
    return good.select("event_id", F.col("parsed.k").alias("k"), F.lit(False).alias("malformed")).union(bad.select("event_id", F.lit(None).cast("long"), F.lit(True)))


@query("""WITH b AS (SELECT source, count(*) AS n, sum(strlen(text)) AS bytes FROM documents GROUP BY source),
told AS (SELECT *, source IN ('src1', 'src2') AS less, CASE source WHEN 'src3' THEN 1 WHEN 'src4' THEN 2 WHEN 'src5' THEN 3 ELSE 0 END AS broken FROM b)
SELECT source AS dataset_id, NOT less AND broken = 0 AS valid, n::bigint AS corpus_files, bytes::bigint AS corpus_bytes,
       concat_ws('|', CASE WHEN less THEN 'missing dirs: acceptance, output' END, CASE broken WHEN 1 THEN 'missing schema/schema.json' WHEN 2 THEN 'schema.json is invalid json' WHEN 3 THEN 'schema.json missing ''routing''' END) AS issues
FROM told""")
def q34_verify_report(t: Tables) -> DataFrame:
    dirs = F.array(*map(F.lit, control.DIRS))
    schema = F.when(F.col("source") == "src3", F.lit(None)).when(F.col("source") == "src4", "{oops").when(F.col("source") == "src5", '{"archetype": "a"}').otherwise('{"archetype": "a", "routing": {"summarization": "m"}}')
    own = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("corpus_files"), F.sum(F.octet_length("text")).cast("long").alias("corpus_bytes"))
    rows = own.select(F.col("source").alias("dataset_id"), "corpus_files", "corpus_bytes", F.when(F.col("source").isin("src1", "src2"), F.slice(dirs, 1, 7)).otherwise(dirs).alias("dirs"), schema.alias("schema_json"))
    return control.verify(rows).withColumn("issues", F.array_join("issues", "|"))


@query("""WITH served AS (
  SELECT n_nationkey AS place, n_name AS provider, CASE n_nationkey % 3 WHEN 0 THEN 'http://127.0.0.1:11434/v1/' WHEN 1 THEN 'http://127.0.0.1/' ELSE 'http://10.0.0.5:8000/' END || n_nationkey AS url,
         unnest([n_name || ':7b', 'Mixed-' || lower(n_name) || '-' || n_regionkey]) AS model, unnest([0, 1]) AS spot
  FROM nation WHERE n_nationkey % 4 <> 3),
wanted AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN substr(n_name, 2, 3) WHEN 2 THEN 'MIXED-' || n_name ELSE 'none of ' || n_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
found AS (SELECT name, arg_min({'p': provider, 'u': url, 'm': model}, {'place': place, 'spot': spot}) AS b FROM (SELECT DISTINCT name FROM wanted) JOIN served ON contains(lower(model), lower(name)) GROUP BY name)
SELECT c_custkey, name, b.p AS provider, b.u AS url, b.m AS model FROM wanted LEFT JOIN found USING (name)""")
def q35_model_resolution(t: Tables) -> DataFrame:
    """Each customer asks for a model by a part of its name; nations serve models, some behind the mesh's own host names, some unhealthy."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    host = F.when(key % 3 == 0, "http://host.docker.internal:11434/v1/").when(key % 3 == 1, "http://host.docker.internal/").otherwise("http://10.0.0.5:8000/")
    models = F.array(F.concat(name, F.lit(":7b")), F.concat(F.lit("Mixed-"), F.lower(name), F.lit("-"), F.col("n_regionkey").cast("string")))
    sources = t("nation").select(key.alias("place"), name.alias("provider"), F.concat(host, key.cast("string")).alias("url"), (key % 4 != 3).alias("healthy"), models.alias("models"))
    asked = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.col("c_custkey") % 4
    wanted = asked.select("c_custkey", F.when(kind == 0, F.lower(name)).when(kind == 1, F.substring(name, 2, 3)).when(kind == 2, F.concat(F.lit("MIXED-"), name)).otherwise(F.concat(F.lit("none of "), name)).alias("name"))
    return control.resolved(sources, wanted)


def message_path() -> Column:
    """Message indexes of an event: none but 0, one up to some thousand, or several large ones."""
    e = F.col("event_id").cast("long")
    zero = F.lit(0).cast("long")
    return F.when(e % 4 == 0, F.array(zero)).when(e % 4 == 1, F.array(e % 5000)).when(e % 4 == 2, F.array(e, e * 1_000_003 % (1 << 31))).otherwise(F.array(e % 64, zero, e * 37, e % 200))


def broken(frame: Column) -> Column:
    """Frames of which a fifth is cut off, before or within the indexes, or has an index of eleven bytes."""
    e = F.col("event_id")
    head, long = F.substring(frame, 1, 4), F.concat(F.substring(frame, 1, 5), F.unhex(F.lit("80" * 10 + "01")))
    return F.when(e % 5 != 0, frame).when(e % 3 == 0, head).when(e % 3 == 1, long).otherwise(F.concat(F.substring(frame, 1, 5), F.unhex(F.lit("0280"))))


def framed_events(events: DataFrame) -> DataFrame:
    own = control.framed(events.withColumn("payload", F.col("event_type").cast("binary")), 7, message_path(), "payload")
    return own.select("event_id", broken(F.col("frame")).alias("frame"))


def _varint(n: str) -> str:
    """The varint of a number that isn't negative, as digits: seven bits a byte, the lowest first."""
    return f"array_to_string(list_transform(list_filter(range(0, 9), lambda i: i = 0 OR (({n}) * 2) >> (7 * i)::int <> 0), lambda i: format('{{:02x}}', ((({n}) * 2 >> (7 * i)::int) & 127) + CASE WHEN ({n}) * 2 >> (7 * i + 7)::int <> 0 THEN 128 ELSE 0 END)), '')"


FRAMES = f"""
paths AS (
  SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN [0] WHEN 1 THEN [event_id % 5000] WHEN 2 THEN [event_id, event_id * 1000003 % 2147483648] ELSE [event_id % 64, 0, event_id * 37, event_id % 200] END AS path FROM events),
framed AS (
  SELECT event_id, event_type, path, '0000000007' || CASE WHEN path = [0] THEN '00' ELSE {_varint("len(path)")} || array_to_string(list_transform(path, lambda x: {_varint("x")}), '') END || lower(hex(event_type)) AS frame FROM paths)"""


@query(f"""WITH {FRAMES}
SELECT event_id, frame, 7::bigint AS schema_id, array_to_string(path, ',') AS path, event_type AS payload, false AS malformed FROM framed WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN '00000000' WHEN 1 THEN '0000000007' || repeat('80', 10) || '01' ELSE '00000000070280' END, NULL, NULL, NULL, true FROM framed WHERE event_id % 5 = 0""")
def q37_frame_codec(t: Tables) -> DataFrame:
    good, bad = control.unframed(framed_events(t("events")))
    null = F.lit(None)
    one = good.select("event_id", F.lower(F.hex("frame")).alias("frame"), "decoded.schema_id", F.array_join("decoded.indexes", ",").alias("path"), F.col("decoded.payload").cast("string").alias("payload"), F.lit(False).alias("malformed"))
    return one.union(bad.select("event_id", F.lower(F.hex("frame")), null.cast("long"), null.cast("string"), null.cast("string"), F.lit(True)))
