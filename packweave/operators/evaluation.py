"""Few-shot prompts and scores of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TASK_LABELS
from ..functions.text import first_line, normalized_answer_ascii, normalized_prediction, stripped
from ..session import small
from .ordering import sample


def label_map(task: str) -> Column:
    return F.array(*[F.lit(x) for x in TASK_LABELS[task]])


def label_name(task: Column, label: Column) -> Column:
    """Name of a label of a task; null for a null or unknown one."""
    table = F.create_map(*[x for t, names in TASK_LABELS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    return F.try_element_at(F.element_at(table, task), label + 1)


# Formats of each task, a demonstration, and the query behind the demonstrations; {x} stand for fields.
CLASS_FORMATS = {
    "agnews": ("Article: {text} Category: {label}\n\n", "Article: {text} Category:"),
    "amazon": ("Title: {title}. Content: {content} Sentiment: {label}\n\n", "Title: {title}. Content: {content} Sentiment:"),
    "dbpedia": ("Title: {title}. Content: {content}\nCategory: {label}\n\n", "Title: {title}. Content: {content}\nCategory:"),
    "yelp": ("text: {text} sentiment: {label}\n\n", "text: {text} sentiment:"),
    "sst2": ("text: {text} sentiment: {label}\n\n", "text: {text} sentiment:"),
    "tweet_hate": ("Text: {text}\nLabel: {label}\n", "Text: {text} Label:"),
    "tweet_offensive": ("Text: {text}\nLabel: {label}\n", "Text: {text} Label:"),
}
# The format of each task.
TASK_FORMATS = {
    **{task: "class" for task in CLASS_FORMATS}, "nq": "cbqa", "tq": "cbqa", "nq_obqa": "contexts", "tq_obqa": "contexts",
    "hotpotqa": "contexts", "squad": "passage",
}
QA_FORMATS = {
    "cbqa": ("Question: {question} Answer: {answer}\n", "Question: {question} Answer:"),
    "contexts": ("Context: {context}Question: {question}\nAnswer: {answer}\n\n", "Context: {context}Question: {question}\nAnswer:"),
    "passage": ("Passage: {context}\nQuestion: {question}\nAnswer: {answer}\n\n", "Passage: {context}\nQuestion: {question}\nAnswer:"),
}


def filled(form: str, fields: dict[str, Column]) -> Column:
    """``form`` with the columns of ``fields`` in place of {name}; null fields are empty."""
    parts, rest = [], form
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            name, _, tail = tail.partition("}")
            parts.append(F.coalesce(fields[name], F.lit("")))
        rest = tail
    return F.concat(*parts)


def contexts_text(ctxs: Column, most: int | None = 2) -> Column:
    """``title. text`` lines of the first ``most`` contexts (all if None)."""
    some = ctxs if most is None else F.slice(ctxs, 1, most)
    return F.array_join(F.transform(some, lambda c: F.concat(c["title"], F.lit(". "), c["text"], F.lit("\n"))), "")


def demonstrations(train: DataFrame, group: list[str], key: str, n: int, seed: int, text: Column) -> DataFrame:
    """The joined texts of ``n`` demonstrations per group, chosen and ordered by the fixed order of ``seed``."""
    from ..functions.tokens import order_key

    picked = sample(train, seed, key, n, group).withColumn("_o", F.struct(order_key(seed, F.col(key)).alias("k"), F.col(key).alias("i"))).withColumn("_t", text)
    return picked.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "").alias("demos"))


def prompts(test: DataFrame, demos: DataFrame, group: list[str], text: Column) -> DataFrame:
    """Test rows with ``prompt``: the demonstrations of their group, then their own text. One small row per group."""
    joined = test.join(small(demos), group, "left")
    return joined.withColumn("prompt", F.concat(F.coalesce("demos", F.lit("")), text)).drop("demos")


def task_texts(task: str) -> tuple[Column, Column]:
    """A demonstration and the closing question of an example of ``task``, from the columns that ``readers.TASKS`` gives."""
    form = TASK_FORMATS[task]
    if form == "class":
        demo, query = CLASS_FORMATS[task]
        columns = ("title", "content") if "{title}" in demo else ("text",)
        fields = {c: stripped(F.col(c)) for c in columns} | {"label": label_name(F.lit(task), F.col("label"))}
        return filled(demo, fields), filled(query, fields)
    demo, query = QA_FORMATS[form]
    fields = {"question": F.col("question")}
    if task in ("nq", "tq"):
        fields["answer"] = F.try_element_at("answer", F.lit(1))
    elif task == "squad":
        fields = {"question": stripped(F.col("question")), "context": stripped(F.col("context")), "answer": stripped(F.try_element_at("answers.text", F.lit(1)))}
    elif task == "hotpotqa":
        pairs = F.transform("context", lambda c: F.concat(c[0], F.lit(". "), F.array_join(F.from_json(c[1], "array<string>"), ""), F.lit("\n")))
        fields |= {"context": F.array_join(pairs, ""), "answer": F.col("answer")}
    else:
        first = F.try_element_at("answers", F.lit(1))
        fields |= {"context": contexts_text(F.col("ctxs")), "answer": F.coalesce("target", first) if task == "tq_obqa" else first}
    return filled(demo, fields), filled(query, fields)


def task_hit(task: str, prediction: Column) -> Column:
    """Whether a prediction is right for the example beside it, by the rule of ``task``; null predictions are wrong."""
    form = TASK_FORMATS[task]
    if form == "class":
        return F.coalesce(normalized_prediction(prediction) == label_name(F.lit(task), F.col("label")), F.lit(False))
    if task == "squad":
        return any_match(normalized_prediction(prediction), F.col("answers.text"))
    if task == "hotpotqa":
        return exact_match(first_line(prediction), F.col("answer"))
    return any_match(first_line(prediction), F.col("answer" if form == "cbqa" else "answers"))


def exact_match(prediction: Column, reference: Column) -> Column:
    return F.coalesce(normalized_answer_ascii(prediction) == normalized_answer_ascii(reference), F.lit(False))


def any_match(prediction: Column, answers: Column) -> Column:
    """Whether the prediction matches one of the answers; an empty or null list matches nothing."""
    p = normalized_answer_ascii(prediction)
    return F.coalesce(F.exists(answers, lambda a: normalized_answer_ascii(a) == p), F.lit(False))


def scores(rows: DataFrame, group: list[str], hit: Column) -> DataFrame:
    """100 times the mean of ``hit`` per group."""
    return rows.groupBy(*group).agg(F.round(100 * F.avg(hit.cast("int")), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def label_accuracy(predictions: DataFrame, tests: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy of predictions (task, example_idx, prediction) against labelled tests; tests without a label are left out."""
    target = tests.where("label is not null").select("task", "example_idx", label_name(F.col("task"), F.col("label")).alias("target"))
    rows = predictions.join(target, ["task", "example_idx"])
    hit = F.coalesce(normalized_prediction(F.col("prediction")) == F.col("target"), F.lit(False))
    return scores(rows, group, hit)


def result_log(results: DataFrame) -> DataFrame:
    """One JSON line per result, keys in the order of the columns."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("line"))
