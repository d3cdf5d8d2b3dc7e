"""Retrieval evaluation against golden questions, by token overlap."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions import text as X
from lorekeep.work import Workspace, small


def concept_text():
    return F.concat_ws("\n", "id", "title", "description", F.array_join("tags", " "), "body")


def retrieve(golden: DataFrame, concepts: DataFrame, index, top_k: int = 5) -> DataFrame:
    """qid, rank, id of the best concepts of each question: one join of all questions' terms with the index."""
    from lorekeep.operators import search

    terms = golden.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(X.tokens("question"))).alias("token"))
    scored = search.score_with_index(index, terms).withColumn("score", search.rounded())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top_k)  # the rank as it is, so that each task cuts its own rows first
    return best.select(F.col("query_id").alias("qid"), F.col("rank").cast("long").alias("rank"), "id")


def context_relevancy(wanted, contexts):
    """Share of contexts (arrays of tokens) with a wanted token; 0 without either."""
    return F.when((F.size(wanted) == 0) | (F.size(contexts) <= 0), F.lit(0.0)).otherwise(F.size(F.filter(contexts, lambda c: F.arrays_overlap(c, wanted))) / F.size(contexts))


def faithfulness(answer, context_tokens):
    """Share of sentences half of whose tokens the contexts hold; sentences without tokens count as unsupported."""
    said = X.sentences(answer)

    def supported(s):
        return X.let(F.array_distinct(X.tokens(s)), lambda t: (F.size(t) > 0) & (F.size(F.array_intersect(t, context_tokens)) >= S.SENTENCE_SUPPORT * F.size(t)))

    return F.when(F.size(said) == 0, F.lit(0.0)).otherwise(F.size(F.filter(said, supported)) / F.size(said))


def answer_relevancy(question, answer):
    return X.let(F.array_distinct(X.tokens(question)), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, X.tokens(answer))) / F.size(q)))


def reference_support(expected, context_tokens):
    return X.let(F.array_distinct(X.tokens(expected)), lambda e: F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(e, context_tokens)) / F.size(e)))


JUDGED = ("context_relevancy", "faithfulness", "answer_relevancy")


def judged(rows: DataFrame, model) -> DataFrame:
    """rows (qid, question, expected_answer, answer, h and the token scores) with a model's scores where its answers can be used, and how each was made.

    The model is asked which of the contexts are relevant, which claims of the answer they support, and how well the answer
    fits. What isn't the JSON asked for, or has no claim, leaves the token score; so does a question without contexts.
    """
    from lorekeep.operators import extract

    ws = Workspace(rows.sparkSession, "judge")
    rows = ws.keep(rows, "rows")
    listed = F.array_join(F.transform("h", lambda x: x["line"]), "\n\n")
    asked = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")))
    prompts = {
        "context_relevancy": F.concat(asked, F.lit("\nExpected answer: "), F.coalesce("expected_answer", F.lit("")), F.lit("\n\nConcepts:\n"), listed, F.lit('\n\nWhich of these ids help to answer? Reply as {"relevant": [ids]}.')),
        "faithfulness": F.concat(F.lit("Context:\n"), listed, F.lit("\n\nAnswer:\n"), "answer", F.lit('\n\nName the claims of the answer and whether the context supports each. Reply as {"claims": [{"claim": text, "supported": true or false}]}.')),
        "answer_relevancy": F.concat(asked, F.lit("\nAnswer: "), "answer", F.lit('\n\nHow well does the answer fit the question, from 0 to 1? Reply as {"score": number}.')),
    }
    able = {"context_relevancy": F.size("h") > 0, "faithfulness": (F.size("h") > 0) & (F.size(X.sentences("answer")) > 0), "answer_relevancy": F.lit(True)}
    each = F.explode(F.filter(F.array(*[F.when(able[m], F.struct(F.concat_ws(":", F.lit(m), "qid").alias("id"), p.alias("prompt"))) for m, p in prompts.items()]), lambda p: p.isNotNull()))
    answers = ws.keep(extract.ask(rows.select(each.alias("p")).select("p.*"), model), "answers")
    said = answers.select(F.substring_index("id", ":", 1).alias("metric"), F.expr("substring(id, instr(id, ':') + 1)").alias("qid"), F.from_json("answer", "relevant array<string>, claims array<struct<claim:string,supported:boolean>>, score double").alias("j"))
    per = said.groupBy("qid").agg(*[F.first(F.when(F.col("metric") == m, F.col("j")), ignorenulls=True).alias(f"j_{m}") for m in JUDGED])
    rows = rows.join(per, "qid", "left")
    right = F.filter("j_context_relevancy.relevant", lambda i: F.array_contains(F.transform("h", lambda x: x["id"]), i))
    claims = F.col("j_faithfulness.claims")
    values = {
        "context_relevancy": F.when(F.col("j_context_relevancy.relevant").isNotNull(), F.size(right) / F.size("h")),
        "faithfulness": F.when(F.size(claims) > 0, F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False)))) / F.size(claims)),
        "answer_relevancy": F.col("j_answer_relevancy.score"),
    }
    held = {m: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))) for m, v in values.items()}  # these two skip nulls
    methods = F.struct(*[F.when(v.isNotNull(), "judge").otherwise("tokens").alias(m) for m, v in held.items()])
    return rows.withColumns({**{m: F.coalesce(v, F.col(m)) for m, v in held.items()}, "methods": methods}).drop(*[f"j_{m}" for m in JUDGED])


def evaluate(golden: DataFrame, concepts: DataFrame, index, top_k: int = 5, thresholds: dict | None = None, judge=None) -> DataFrame:
    """One row a question: scores, their mean, failing, missing citations, diagnosis, verdict. With a judge (a model) its scores stand where they can, and methods says where."""
    limits = S.EVAL_THRESHOLDS | (thresholds or {})
    hits = Workspace(concepts.sparkSession, "evaluate").keep(retrieve(golden, concepts, index, top_k), "hits")  # at most top_k a question
    found = concepts.join(small(hits.select("id").distinct()), "id", "left_semi")  # only what was found is taken apart
    texts = found.select("id", X.tokens(concept_text()).alias("tok"), F.concat(F.lit("["), F.col("id"), F.lit("] "), X.snippet(F.when(~X.blank("description"), F.col("description")).otherwise(F.col("body")))).alias("line"))
    per = hits.join(texts, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tok", "line"))).alias("h"))
    rows = golden.withColumnRenamed("id", "qid").join(per, "qid", "left").withColumn("h", F.coalesce("h", F.from_json(F.lit("[]"), "array<struct<rank:bigint,id:string,tok:array<string>,line:string>>")))
    rows = rows.withColumn("answer", F.array_join(F.transform("h", lambda x: x["line"]), "\n")).withColumn("ctx", F.array_distinct(F.flatten(F.transform("h", lambda x: x["tok"]))))
    wanted = F.array_distinct(F.concat(X.tokens("question"), X.tokens("expected_answer")))
    rows = rows.withColumns({
        "context_relevancy": context_relevancy(wanted, F.transform("h", lambda x: x["tok"])), "faithfulness": faithfulness("answer", F.col("ctx")),
        "answer_relevancy": answer_relevancy("question", "answer"), "reference_support": reference_support("expected_answer", F.col("ctx")),
        "retrieved": F.transform("h", lambda x: x["id"]),
    })
    if judge is not None:
        rows = judged(rows, judge)
    missing = F.array_except(F.coalesce("must_cite", F.array().cast("array<string>")), "retrieved")
    failing = F.filter(F.array(*[F.when(F.col(m) < t, F.lit(m)) for m, t in limits.items()]), lambda m: m.isNotNull())
    rows = rows.withColumn("missing", missing).withColumn("failing", failing)
    retrieval = (F.size("missing") > 0) | F.array_contains("failing", "context_relevancy")
    diagnosis = F.when(retrieval, "retrieval").when(F.size("failing") > 0, "generation").otherwise("ok")
    mean = (F.col("context_relevancy") + F.col("faithfulness") + F.col("answer_relevancy")) / 3
    return rows.select("qid", "context_relevancy", "faithfulness", "answer_relevancy", "reference_support", mean.alias("overall"), "failing", "missing", diagnosis.alias("diagnosis"), ((F.size("failing") == 0) & (F.size("missing") == 0)).alias("passed"), "retrieved", *(["methods"] if judge is not None else []))


def report(results: DataFrame) -> DataFrame:
    """Means of the metrics, counts and the gate, in one row."""
    return results.agg(
        F.avg("context_relevancy").alias("context_relevancy"), F.avg("faithfulness").alias("faithfulness"), F.avg("answer_relevancy").alias("answer_relevancy"), F.avg("overall").alias("overall"),
        F.count(F.lit(1)).alias("questions"), F.count_if("passed").alias("passed"), F.count_if(F.col("diagnosis") == "retrieval").alias("retrieval"), F.count_if(F.col("diagnosis") == "generation").alias("generation"),
    ).withColumn("gate", F.when((F.col("questions") > 0) & (F.col("passed") == F.col("questions")), "pass").otherwise("fail"))


def sample_golden(concepts: DataFrame, n: int = 3) -> DataFrame:
    """Demonstration questions from the first concepts."""
    first = concepts.orderBy("id").limit(n)
    return first.select(F.concat(F.lit("sample-"), F.col("id")).alias("id"), F.concat(F.lit("What is "), F.coalesce("title", "id"), F.lit("?")).alias("question"), F.coalesce("description", F.lit("")).alias("expected_answer"), F.array("id").alias("must_cite"))


def check_golden(golden: DataFrame, max_questions: int = 1000) -> DataFrame:
    """code, id of what is wrong with a golden set: blank fields, repeated ids, too many questions."""
    blank = golden.filter(X.blank("id") | X.blank("question")).select(F.lit("blank_field").alias("code"), "id")
    twice = golden.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_id"), "id")
    many = golden.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_questions).select(F.lit("too_many"), F.lit(None).cast("string"))
    return blank.union(twice).union(many)
