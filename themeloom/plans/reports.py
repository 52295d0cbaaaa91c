"""End-to-end jobs over a corpus and fitted models: the tables that reports, maps and raters need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.operators import corpus as K
from themeloom.operators import distribution as D
from themeloom.operators import scoring as S
from themeloom.operators import topicmap as M
from themeloom.operators import topics as TP
from themeloom.operators.labels import with_labels
from themeloom.plans.training import Fitted


def distribution(doc_topic: DataFrame, labels: DataFrame, topics: int | dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The per-topic and the per-model distribution tables."""
    counts = D.topic_counts(doc_topic, topics)
    return D.distribution_table(counts, labels), D.summary_table(counts, labels)


def rating_sheet(fitted: Fitted, doc_topic: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blind item table and its key. Fails when weights and corpus do not hold the same documents."""
    require_alignment(corpus, doc_topic)
    return TP.blind_items(fitted.topic_terms(corpus.sparkSession), doc_topic, corpus)


def require_alignment(corpus: DataFrame, doc_topic: DataFrame) -> None:
    """Raises unless every model's weights cover exactly the documents of the corpus. One join for all models."""
    models = [r["model"] for r in doc_topic.select("model").distinct().collect()]
    wanted = corpus.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "doc_id", F.lit(1).alias("text")) if models else None
    if wanted is None:
        return
    held = doc_topic.select("model", "doc_id", F.lit(1).alias("weighted"))
    found = wanted.join(held, ["model", "doc_id"], "full").groupBy("model").agg(
        F.count_if(F.col("weighted").isNull()).alias("bare"), F.count_if(F.col("text").isNull()).alias("lost")
    ).where("bare > 0 OR lost > 0").orderBy("model").first()
    if found:
        raise ValueError(
            f"{found['model']}: {found['bare']} documents without weights and "
            f"{found['lost']} weights without a document; fit the models again"
        )


def overview(fitted: Fitted, doc_topic: DataFrame, corpus: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """The small tables that reports print, by name, over a stored corpus and stored weights."""
    topics = {name: model.n_topics for name, model in fitted.models.items()}
    counts = D.topic_counts(doc_topic, topics)
    examples = TP.with_texts(TP.representatives(doc_topic), corpus)
    return {
        "corpus_summary": K.summary(corpus).join(K.median_length(corpus)), "top_words": K.word_counts(corpus),
        "length_histogram": K.length_histogram(corpus).orderBy("bin"),
        "style_share": D.style_share(counts, labels).orderBy("model", "writing_style"),
        "executive_facts": D.executive_facts(counts, labels).orderBy("model"),
        "representatives": with_labels(examples, labels).select(
            "model", "topic", "topic_name", "example", "doc_id", "weight", "share", T.quote(F.col("raw_text")).alias("quote")
        ).orderBy("model", "topic", "example"),
        "report_table": S.report_table(doc_topic, fitted.topic_terms(corpus.sparkSession), labels, topics).orderBy("model", "topic"),
    }


def topic_map(fitted: Fitted, doc_topic: DataFrame, lambdas: list[float] | None = None) -> dict[str, DataFrame]:
    """The tables of the topic map of every model: prevalence, salient and relevant terms, tokens, distances."""
    shares = M.topic_term_shares(fitted.topic_terms(doc_topic.sparkSession))
    prevalence = M.prevalence(M.mapped_documents(doc_topic))
    frequencies = M.term_frequencies(shares, prevalence)
    salient = M.saliency(frequencies, C.MAP_TERMS)
    relevant = M.relevance(frequencies, lambdas)
    shown = salient.select("model", "term").union(relevant.select("model", "term"))
    return {
        "prevalence": prevalence, "salient": salient, "relevant": relevant,
        "tokens": M.token_table(frequencies, shown), "distances": M.topic_distances(shares),
    }
