"""Queries over answers, scores and prompts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..config import TASK_LABELS
from ..functions.text import first_line as first_line_of
from ..functions.text import normalized_answer, normalized_answer_ascii, normalized_prediction, stripped
from ..operators import evaluation as ev
from ..session import table
from . import pipelines

SHOTS = 3
SEED = 42
OWN = ("agnews", "yelp", "sst2", "tweet_hate", "tweet_offensive")
BASE = "agnews"


def _tests(s, d):
    return table(s, d, "eval_cls").where("split_name = 'test'")


def _predictions(s, d):
    return table(s, d, "predictions")


def normalize_answer_ascii(s, d):
    return _predictions(s, d).select("pred_id", normalized_answer_ascii(F.col("prediction")).alias("answer"))


def normalize_answer_nfd(s, d):
    """Any Unicode text, here all held-out texts."""
    return table(s, d, "split_eval").select("eval_id", normalized_answer(F.col("text")).alias("answer"))


def first_line(s, d):
    return _predictions(s, d).select("pred_id", first_line_of(F.col("prediction")).alias("line"), normalized_prediction(F.col("prediction")).alias("normalised"))


def _with_target(s, d):
    t = _tests(s, d).where("label is not null").select("task", "example_idx", ev.label_name(F.col("task"), F.col("label")).alias("target"))
    return _predictions(s, d).join(t, ["task", "example_idx"])


def accuracy(s, d):
    return ev.label_accuracy(_predictions(s, d), _tests(s, d), ["model", "task", "n_shot", "seed"])


def seed_average(s, d):
    """Accuracy per model, task and number of shots, averaged over seeds."""
    return accuracy(s, d).groupBy("model", "task", "n_shot").agg(F.round(F.avg("score"), 5).alias("score"), F.count(F.lit(1)).alias("seeds"))


def em_single(s, d):
    rows = _with_target(s, d)
    return ev.scores(rows, ["model", "task"], ev.exact_match(first_line_of(F.col("prediction")), F.col("target")))


def _answers(target):
    return F.array(target, F.concat(F.lit("the "), target, F.lit(".")), F.upper(target))


def em_any(s, d):
    rows = _with_target(s, d)
    hit = ev.any_match(F.col("prediction"), _answers(F.col("target")))
    return rows.select("pred_id", F.col("example_idx"), hit.alias("hit"))


def em_avg(s, d):
    rows = _with_target(s, d)
    return ev.scores(rows, ["model", "task"], ev.any_match(first_line_of(F.col("prediction")), _answers(F.col("target"))))


def _class_prompts(s, d, tasks=None):
    rows = table(s, d, "eval_cls").where("label is not null").withColumn("name", ev.label_name(F.col("task"), F.col("label")))
    fields = {"text": stripped(F.col("text")), "label": F.col("name")}
    demo, query = F.lit(None).cast("string"), F.lit(None).cast("string")
    for task, (a, b) in ev.CLASS_FORMATS.items():
        if "{title}" not in a:
            demo = F.when(F.col("task") == task, ev.filled(a, fields)).otherwise(demo)
            query = F.when(F.col("task") == task, ev.filled(b, fields)).otherwise(query)
    demos = ev.demonstrations(rows.where("split_name = 'train'"), ["task"], "eval_id", SHOTS, SEED, demo)
    return ev.prompts(rows.where("split_name = 'test'"), demos, ["task"], query)


def prompt_classify(s, d):
    return _class_prompts(s, d).select("eval_id", "task", "prompt")


def _titled(s, d):
    """Held-out documents as reviews: first line the title, the rest the content, the label from the id."""
    t = table(s, d, "split_eval").where("text is not null")
    lines = F.split("text", "\n", 2)
    return t.select("eval_id", "split_name", lines[0].alias("title"), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("content"), (F.col("eval_id") % 2).cast("int").alias("label"))


def prompt_title_content(s, d):
    rows = _titled(s, d).withColumn("g", F.lit("amazon"))
    fields = {"title": stripped(F.col("title")), "content": stripped(F.col("content")), "label": ev.label_name(F.col("g"), F.col("label"))}
    a, b = ev.CLASS_FORMATS["amazon"]
    demos = ev.demonstrations(rows.where("split_name = 'validation'"), ["g"], "eval_id", SHOTS, SEED, ev.filled(a, fields))
    return ev.prompts(rows.where("split_name = 'test'"), demos, ["g"], ev.filled(b, fields)).select("eval_id", "prompt")


def _questions(s, d):
    """Questions from the classification tasks: the text asks, the label answers."""
    rows = table(s, d, "eval_cls").where("label is not null").withColumn("answer", ev.label_name(F.col("task"), F.col("label")))
    return rows.select("eval_id", "split_name", F.lit("g").alias("g"), F.col("text").alias("question"), "answer", "task")


def _qa_prompts(s, d, form, context=None):
    rows = _questions(s, d)
    fields = {"question": F.col("question"), "answer": F.col("answer"), "context": context if context is not None else F.lit("")}
    a, b = ev.QA_FORMATS[form]
    demos = ev.demonstrations(rows.where("split_name = 'train'"), ["g"], "eval_id", SHOTS, SEED, ev.filled(a, fields))
    return ev.prompts(rows.where("split_name = 'test'"), demos, ["g"], ev.filled(b, fields)).select("eval_id", "prompt")


def prompt_cbqa(s, d):
    return _qa_prompts(s, d, "cbqa")


def prompt_contexts(s, d):
    """Two of three contexts, each with its title."""
    ctx = F.array(*[F.struct(F.concat(F.col("task"), F.lit(f" {i}")).alias("title"), F.col("question").alias("text")) for i in (1, 2, 3)])
    return _qa_prompts(s, d, "contexts", ev.contexts_text(ctx))


def prompt_passage(s, d):
    return _qa_prompts(s, d, "passage", stripped(F.col("question")))


def task_tables(s, d, task):
    """Train, test and prediction tables of a task in its own form, made from the classification tasks: their own rows, or
    those of BASE with the text as question or content and the label's name as answer."""
    base = task if task in OWN else BASE
    rows = table(s, d, "eval_cls").where((F.col("task") == base) & F.col("label").isNotNull() & F.col("text").isNotNull())
    name, n, text = ev.label_name(F.lit(base), F.col("label")), F.col("example_idx"), F.col("text")
    contexts = [F.struct(F.concat(F.lit(f"T{i} "), n.cast("string")).alias("title"), F.concat(text, F.lit(f" {i}")).alias("text")) for i in (1, 2, 3)]
    pairs = [F.array(c["title"], F.to_json(F.array(c["text"], F.lit(" End.")))) for c in contexts]
    columns = {
        "nq": [text.alias("question"), F.array(name, F.concat(F.lit("the "), name, F.lit("."))).alias("answer")],
        "nq_obqa": [text.alias("question"), F.array(F.upper(name), F.lit("none")).alias("answers"), F.array(*contexts).alias("ctxs")],
        "hotpotqa": [text.alias("question"), name.alias("answer"), F.array(*pairs).alias("context")],
        "squad": [text.alias("context"), F.concat(F.lit(" what is "), n.cast("string"), F.lit("? ")).alias("question"), F.struct(F.array(name, F.lit("none")).alias("text")).alias("answers")],
        "amazon": [F.concat(F.lit(" T "), n.cast("string")).alias("title"), text.alias("content"), (n % 2).cast("int").alias("label")],
        "dbpedia": [F.concat(F.lit(" T "), n.cast("string")).alias("title"), text.alias("content"), (n % 14).cast("int").alias("label")],
    }
    columns["tq"] = columns["nq"]
    columns["tq_obqa"] = [*columns["nq_obqa"], F.when(n % 2 == 0, F.concat(F.lit("target "), name)).alias("target")]
    shaped = rows.select("split_name", "example_idx", *columns.get(task, [text, F.col("label")]))
    predictions = _predictions(s, d).where(F.col("task") == base).select("example_idx", "prediction")
    return shaped.where("split_name = 'train'").drop("split_name"), shaped.where("split_name = 'test'").drop("split_name"), predictions


def _task_query(task):
    def query(s, d):
        train, test, predictions = task_tables(s, d, task)
        asked = pipelines.task_prompts(task, train, test, SHOTS, SEED)
        rows = pipelines.judged(task, asked, predictions)
        return rows.groupBy("example_idx", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")).agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count(F.lit(1)).alias("answers"))

    query.__name__ = f"task_{task}"
    query.__doc__ = f"Prompts and right answers of each example of {task}."
    return query


def task_scores(s, d):
    """The score of every task."""
    parts = []
    for task in ev.TASK_FORMATS:
        train, test, predictions = task_tables(s, d, task)
        parts.append(pipelines.evaluate_task(task, train, test, predictions, SHOTS, SEED))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def result_log(s, d):
    rows = seed_average(s, d).select("task", "model", F.col("n_shot").cast("int").alias("n_shot"), F.col("seeds").cast("int").alias("seeds"))
    return ev.result_log(rows)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_answer_ascii, normalize_answer_nfd, first_line, accuracy, seed_average, em_single, em_any, em_avg, prompt_classify,
        prompt_title_content, prompt_cbqa, prompt_contexts, prompt_passage, task_scores, result_log, *map(_task_query, ev.TASK_FORMATS),
    )
}


def _norm(x: str) -> str:
    """The answer rule by splitting at what isn't a word character, since RE2 has no look-around."""
    low = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    # a letter, digit or other sign beside an article makes it another word: look at runs of word signs
    parts = f"regexp_extract_all({low}, '[a-z0-9]+|[^a-z0-9]+')"
    return f"trim(regexp_replace(array_to_string(list_transform({parts}, lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))"


def _decomposed(x: str) -> str:
    """Letters with marks of the Latin and Cyrillic blocks as letters and marks, by Unicode's own table."""
    for code in (*range(0xC0, 0x180), *range(0x400, 0x460)):
        if (apart := unicodedata.normalize("NFD", chr(code))) != chr(code):
            x = f"replace({x}, '{chr(code)}', '{apart}')"
    return x


_BL = "[\\s\\x1c-\\x1f\\x0B\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BL}+|{_BL}+$', '', 'g')"


def _pred(x: str) -> str:
    return _strip(f"string_split({_strip(x)}, chr(10))[1]")


_CASE = "CASE task " + " ".join(
    f"WHEN '{t}' THEN list_extract([{', '.join(repr(n) for n in names)}], label + 1)" for t, names in TASK_LABELS.items()
) + " END"
_JOINED = (
    f"WITH t AS (SELECT task, example_idx, {_CASE} AS target FROM eval_cls WHERE split_name = 'test' AND label IS NOT NULL), "
    "r AS (SELECT p.*, t.target FROM predictions p JOIN t USING (task, example_idx)) "
)
_ACC = _JOINED.rstrip() + f", acc AS (SELECT model, task, n_shot, seed, round(100 * avg(CAST(coalesce({_pred('prediction')} = target, false) AS INTEGER)), 6) AS score, count(*) AS n FROM r GROUP BY 1, 2, 3, 4)"
_ANY = f"coalesce({_norm('target')} = @p OR {_norm(chr(39) + 'the ' + chr(39) + ' || target || ' + chr(39) + '.' + chr(39))} = @p OR {_norm('upper(target)')} = @p, false)"
_FIRST = "string_split(prediction, chr(10))[1]"
_DEMO_FORMS = {t: f for t, f in ev.CLASS_FORMATS.items() if "{title}" not in f[0]}


def _form(form: str, **fields: str) -> str:
    parts = []
    while form:
        head, brace, rest = form.partition("{")
        if head:
            parts.append("'" + head.replace("'", "''") + "'")
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(f"coalesce({fields[name]}, '')")
        form = rest
    return " || ".join(parts)


def _prompt(rows: str, group: str, demo: str, query: str, train: str, cols: str) -> str:
    return (
        f"WITH rows AS ({rows}), tr AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('{SEED}-' || eval_id), eval_id) AS r, {demo} AS dt FROM rows WHERE split_name = '{train}'), "
        f"dm AS (SELECT {group} AS gg, string_agg(dt, '' ORDER BY r) AS demos FROM tr WHERE r <= {SHOTS} GROUP BY 1) "
        f"SELECT {cols}, coalesce(demos, '') || {query} AS prompt FROM rows LEFT JOIN dm ON gg = {group} WHERE split_name = 'test'"
    )


_CLS_ROWS = f"SELECT eval_id, split_name, task, text, {_CASE} AS name FROM eval_cls WHERE label IS NOT NULL"
_QA_ROWS = f"SELECT eval_id, split_name, 'g' AS g, task, text AS question, {_CASE} AS answer FROM eval_cls WHERE label IS NOT NULL"
_TITLED = "SELECT eval_id, split_name, 'amazon' AS g, string_split(text, chr(10))[1] AS title, CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS content, ['negative', 'positive'][eval_id % 2 + 1] AS name FROM split_eval WHERE text IS NOT NULL"


def _qa(form: str, context: str = "''") -> str:
    a, b = ev.QA_FORMATS[form]
    f = {"question": "question", "answer": "answer", "context": context}
    return _prompt(_QA_ROWS, "g", _form(a, **f), _form(b, **f), "train", "eval_id")


_cls_field = {"text": _strip("text"), "label": "name"}
_demo_case = "CASE task " + " ".join(f"WHEN '{t}' THEN {_form(a, **_cls_field)}" for t, (a, _) in _DEMO_FORMS.items()) + " END"
_query_case = "CASE task " + " ".join(f"WHEN '{t}' THEN {_form(b, **_cls_field)}" for t, (_, b) in _DEMO_FORMS.items()) + " END"
_ttl = {"title": _strip("title"), "content": _strip("content"), "label": "name"}

_WORDS_OF = f"regexp_extract_all(regexp_replace(lower({_decomposed('text')}), '[!-/:-@\\[-`{{-~]', '', 'g'), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"

SQL = {
    "normalize_answer_nfd": f"SELECT eval_id, {_strip(f"regexp_replace(array_to_string(list_transform({_WORDS_OF}, lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '{_BL}+', ' ', 'g')")} AS answer FROM split_eval",
    "normalize_answer_ascii": f"SELECT pred_id, {_norm('prediction')} AS answer FROM predictions",
    "first_line": f"SELECT pred_id, {_FIRST} AS line, {_pred('prediction')} AS normalised FROM predictions",
    "accuracy": _ACC + " SELECT * FROM acc",
    "seed_average": _ACC + " SELECT model, task, n_shot, round(avg(score), 5) AS score, count(*) AS seeds FROM acc GROUP BY 1, 2, 3",
    "em_single": _JOINED + f"SELECT model, task, round(100 * avg(CAST(coalesce({_norm(_FIRST)} = {_norm('target')}, false) AS INTEGER)), 6) AS score, count(*) AS n FROM r GROUP BY 1, 2",
    "em_any": _JOINED + f"SELECT pred_id, example_idx, {_ANY.replace('@p', _norm('prediction'))} AS hit FROM r",
    "em_avg": _JOINED + f"SELECT model, task, round(100 * avg(CAST({_ANY.replace('@p', _norm(_FIRST))} AS INTEGER)), 6) AS score, count(*) AS n FROM r GROUP BY 1, 2",
    "prompt_classify": _prompt(_CLS_ROWS, "task", _demo_case, _query_case, "train", "eval_id, task"),
    "prompt_title_content": _prompt(_TITLED, "g", _form(ev.CLASS_FORMATS["amazon"][0], **_ttl), _form(ev.CLASS_FORMATS["amazon"][1], **_ttl), "validation", "eval_id"),
    "prompt_cbqa": _qa("cbqa"),
    "prompt_contexts": _qa("contexts", " || ".join(f"task || ' {i}. ' || question || chr(10)" for i in (1, 2))),
    "prompt_passage": _qa("passage", _strip("question")),
    "result_log": _ACC
    + """, sa AS (SELECT task, model, n_shot, count(*) AS seeds FROM acc GROUP BY 1, 2, 3)
    SELECT '{"task":"' || task || '","model":"' || model || '","n_shot":' || n_shot || ',"seeds":' || seeds || '}' AS line FROM sa""",
}


def _task_sql(task: str) -> str:
    """CTEs up to ``res`` (example_idx, prompt, hit), one row per test example and prediction."""
    base = task if task in OWN else BASE
    names = TASK_LABELS[task] if ev.TASK_FORMATS[task] == "class" else TASK_LABELS[BASE]
    label = {"amazon": "example_idx % 2", "dbpedia": "example_idx % 14"}.get(task, "label")
    rows = f"rows AS (SELECT split_name, example_idx, text, list_extract([{', '.join(repr(n) for n in names)}], CAST({label} AS INTEGER) + 1) AS name FROM eval_cls WHERE task = '{base}' AND label IS NOT NULL AND text IS NOT NULL)"
    end = "" if task != "hotpotqa" else " || ' End.'"
    most = 3 if task == "hotpotqa" else 2
    context = " || ".join(f"'T{i} ' || example_idx || '. ' || text || ' {i}'{end} || chr(10)" for i in range(1, most + 1))
    first_of, read = _norm("string_split(prediction, chr(10))[1]"), _norm(_pred("prediction"))
    fields, answers = {"question": "text", "context": context}, []
    if ev.TASK_FORMATS[task] == "class":
        demo, ask = ev.CLASS_FORMATS[task]
        fields = {"text": _strip("text"), "content": _strip("text"), "title": "'T ' || example_idx", "label": "name"}
        hit = f"{_pred('prediction')} = name"
    else:
        demo, ask = ev.QA_FORMATS[ev.TASK_FORMATS[task]]
        if task in ("nq", "tq"):
            fields["answer"], answers = "name", ["name", "'the ' || name || '.'"]
        elif task == "hotpotqa":
            fields["answer"], answers = "name", ["name"]
        elif task == "squad":
            fields = {"question": "'what is ' || example_idx || '?'", "context": _strip("text"), "answer": "name"}
            first_of, answers = read, ["name", "'none'"]
        else:
            fields["answer"] = "upper(name)" if task == "nq_obqa" else "CASE WHEN example_idx % 2 = 0 THEN 'target ' || name ELSE upper(name) END"
            answers = ["upper(name)", "'none'"]
        hit = " OR ".join(f"{first_of} = {_norm(a)}" for a in answers)
    pool = "SELECT * FROM rows WHERE split_name = 'train'"
    if task in pipelines.POOLED:
        pool += f" ORDER BY md5('{pipelines.CBQA_POOL_SEED}-' || example_idx), example_idx LIMIT {pipelines.CBQA_POOL}"
    return (
        f"WITH {rows}, pool AS ({pool}), tr AS (SELECT {_form(demo, **fields)} AS dt, row_number() OVER (ORDER BY md5('{SEED}-' || example_idx), example_idx) AS r FROM pool), "
        f"dm AS (SELECT string_agg(dt, '' ORDER BY r) AS demos FROM tr WHERE r <= {SHOTS}), "
        f"te AS (SELECT example_idx, name, coalesce(demos, '') || {_form(ask, **fields)} AS prompt FROM rows, dm WHERE split_name = 'test'), "
        f"res AS (SELECT te.example_idx, prompt, coalesce({hit}, false) AS hit FROM te LEFT JOIN (SELECT example_idx, prediction FROM predictions WHERE task = '{base}') USING (example_idx))"
    )


SQL |= {
    f"task_{t}": _task_sql(t) + " SELECT example_idx, md5(prompt) AS prompt_md5, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, count(*) AS answers FROM res GROUP BY 1, prompt"
    for t in ev.TASK_FORMATS
}
SQL["task_scores"] = " UNION ALL ".join(
    f"SELECT * FROM ({_task_sql(t)} SELECT '{t}' AS task, CAST({SHOTS} AS INTEGER) AS n_shot, CAST({SEED} AS INTEGER) AS seed, round(100 * avg(CAST(hit AS INTEGER)), 6) AS score, count(*) AS n FROM res)" for t in ev.TASK_FORMATS
)
