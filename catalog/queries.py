"""One query per operator, each over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import vocabulary as V
from namesift.functions import fixed, names, prompts
from namesift.functions import text as X
from namesift.functions.fixed import COUNT_CATEGORIES
from namesift.operators import answers, boundaries, categories, clusters, evaluation, fuzzy, ids, inference, linking, markup, matching, mentions
from namesift.operators import ranked, retrieval, routing, scoring, tagger, votes
from namesift.plans import record_to_record, row_to_question, text_to_entity, title_guess
from namesift.session import spread, stage, stage_path, tune
from namesift.sources import read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RESULTS = 5
SETTLED_MORE_THAN = 2
SETTLED_SCORE = 0.75


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# ---- inputs several queries share --------------------------------------------


def language_dictionary(spark: SparkSession) -> DataFrame:
    phrases, languages, scores = zip(*V.LANGUAGE_PHRASES)
    entries = pa.table({"phrase": phrases, "text": languages, "score": scores})
    return spark.createDataFrame(entries).withColumn("entity_detected", F.lit("LANGUAGE"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("gold")))


def gold_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("gold"))


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


def language_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.extract_gazetteer(documents(spark, sf_dir), language_dictionary(spark))


def pattern_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.extract_patterns(documents(spark, sf_dir), V.MENTION_PATTERNS)


def language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.count_votes(language_mentions(spark, sf_dir))


def matched_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_languages(spark, sf_dir)
    return stage(text_to_entity.first_pass(language_mentions(spark, sf_dir), gold, "LANGUAGE"), "matched")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_score", F.round("avg_score", 6))


def language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_match_rank(matched_languages(spark, sf_dir), ids=gold_languages(spark, sf_dir))


def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.classify(documents(spark, sf_dir), "text", V.LANGUAGE_WORDS)


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.store(pages_html(spark, sf_dir))


def top_pages(spark: SparkSession, sf_dir: str, rare_pages: int = retrieval.RARE_PAGES) -> DataFrame:
    n_pages = table(spark, sf_dir, "pages").count()
    searches = table(spark, sf_dir, "benchmark")
    return retrieval.retrieve_pages(page_index(spark, sf_dir), n_pages, searches, "item_id", "text", RESULTS, rare_pages)


def number_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nationkey"), F.regexp_replace("s_name", "^[^1-9]*", "").alias("s_number")
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nationkey"), F.regexp_replace("c_name", "^[^1-9]*", "").alias("c_number")
    )
    return suppliers, customers


def number_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = number_tables(spark, sf_dir)
    return linking.candidate_pairs(suppliers, customers, "s_number", "c_number", ["nationkey"])


# ---- sources -------------------------------------------------------------------


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents_table = table(spark, sf_dir, "documents")
    path = stage_path(spark, "csv")
    write_table(documents_table, path, "csv", escaped=True)
    return read_table(spark, path, "csv", documents_table.schema, escaped=True)


@query
def catalog_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"documents_{uuid.uuid4().hex}"
    write_table(table(spark, sf_dir, "documents").filter("lang = 'en'"), name, "table")
    write_table(table(spark, sf_dir, "documents").filter("lang <> 'en'"), name, "table")
    return read_table(spark, name, "table")


@query
def csv_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = stage_path(spark, "csv")
    write_table(part, path, "csv", header=False)
    return read_table(spark, path, "csv", part.schema, header=False, index="rename").select("id", "p_name", "p_size")


# ---- ids and scalar expressions --------------------------------------------------


@query
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ids.assign_ids(docs, by=["doc_id"])


@query
def assign_ids_to_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.assign_ids(table(spark, sf_dir, "documents").select("text"))


@query
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.normalize_label(F.col("text")).alias("label"))


@query
def clean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "system", "Unknown.").otherwise(F.col("text"))
    answers = turns.select("conv_id", "turn", X.clean_answer(said).alias("answer"))
    return answers.filter(F.col("answer").isNotNull())


@query
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.canonical_key(F.col("text")).alias("canonical_key"))


@query
def link_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sized = F.concat_ws("_", F.lower("p_type"), F.substring_index("p_name", " ", -1))
    titles = part.groupBy(sized.alias("title")).agg(F.min("p_size").alias("smallest"))
    linked = linking.link_by_key(part.select("p_partkey", "p_name"), titles, "p_name", "title")
    return linked.select("p_partkey", "p_name", "canonical_key", "title", "smallest")


@query
def row_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") > 10, X.canonical_key(F.col("p_name")))
    question = X.row_question(
        F.concat_ws("", F.lit("Which part of size "), X.whole_number_text(F.col("p_size"))),
        [(" is called ", X.display_name(key)), (" and made by ", F.col("p_brand"))],
        "?",
    )
    return part.select("p_partkey", question.alias("question"))


@query
def gold_title_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    films = part.filter("p_size > 25").select(
        X.canonical_key(F.col("p_name")).alias("title"),
        F.lower("p_brand").alias("director"),
        *[F.lit(None).cast("string").alias(f"actor_{k}") for k in (1, 2, 3)],
        F.lit(None).cast("double").alias("release_yr"),
    )
    labelled = part.filter("p_size <= 40").select(F.col("p_name").alias("movie"))
    gold = row_to_question.gold_titles(labelled, films).filter(F.col("title").isNotNull())
    return row_to_question.film_questions(films.distinct(), gold)


@query
def film_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    films = part.select(
        F.concat_ws("_", F.lit("part"), F.col("p_partkey")).alias("title"),
        F.when(F.col("p_size") > 10, X.canonical_key(F.col("p_name"))).alias("director"),
        F.when(F.col("p_size") > 20, F.lower("p_type")).alias("actor_1"),
        F.when(F.col("p_size") > 30, F.lower("p_brand")).alias("actor_2"),
        F.lit(None).cast("string").alias("actor_3"),
        F.when(F.col("p_size") != 13, F.col("p_size") + F.lit(1950.0)).alias("release_yr"),
    )
    return row_to_question.film_questions(films, films.filter(F.col("director").isNotNull() | (F.col("actor_1").isNull())))


@query
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") > 10, F.col("p_brand"))
    price = X.whole_number_text(F.col("p_retailprice"))
    terms = X.search_terms(F.col("p_name"), brand, F.col("p_type"), price)
    return part.select("p_partkey", terms.alias("search_terms"))


@query
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        prompts.entity_prompt(text, "official title of the movie").alias("entity"),
        prompts.category_prompt(text, COUNT_CATEGORIES).alias("category"),
        prompts.attribute_prompt(text).alias("attribute"),
        prompts.instruction_prompt(prompts.wrapped_question(text)).alias("instruction"),
    )


@query
def first_name_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.first_name_prompt(F.col("p_type"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@query
def first_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = X.first_name_match(F.col("p_type"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"))


@query
def judge_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    judged = record_to_record.judge_first_names(part, "p_type", "p_name", inference.CueBackend(V.NAME_CUES))
    return judged.select("p_partkey", "is_first_name")


@query
def template_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sentence = F.concat_ws(" ", F.lit("part"), F.col("p_partkey"), F.lit("is"), F.col("p_name"))
    return part.select("p_partkey", X.template_category(sentence, V.SIZE_CATEGORIES).alias("category"))


@query
def template_category_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.template_category(F.col("text")).alias("category"))


@query
def url_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.url_title(url).alias("url_title"), X.url_words(url).alias("url_words")
    )


@query
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_join(X.page_links(F.col("html"), RESULTS), " ")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("links"))


@query
def page_list_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_join(X.page_links(F.col("html"), RESULTS, r'<li><a href="([^"]*)"'), " ")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("links"))


def restyled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with links of two classes, written in other ways, beside what only looks like a link."""
    shown = F.regexp_replace("html", '<a href="/([a-mA-M][^"]*)">', "<A title='see > $1' CLASS='wide result' href=\"/$1\">")
    plain = F.regexp_replace(shown, '<a href="/([^"]*)">', '<a class=other href="/$1">')
    trap = '<script>x = \'<a class="result" href="/trap">\';</script><!-- <a class="result" href="/trap">t</a> -->'
    html = F.regexp_replace(F.regexp_replace(plain, "<body>", f"<body>{trap}"), "<title>", "<TITLE lang='x'\n>")
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query
def links_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.links_by_class(restyled_pages(spark, sf_dir), "result", RESULTS)


@query
def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter("page_id is not null")
    return markup.select_elements(pages, markup.Selector("div", frozenset(["ad"])), 1, "class").select("id", "class", "text")


@query
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_titles(restyled_pages(spark, sf_dir))


# ---- mentions ----------------------------------------------------------------------


@query
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.split_sentences(documents(spark, sf_dir))


@query
def learned_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.abbreviations(stage(boundaries.word_points(documents(spark, sf_dir)), "points"))


@query
def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.learned_sentences(documents(spark, sf_dir))


@query
def extract_mentions_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_mentions(spark, sf_dir)


@query
def extract_mentions_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mentions(spark, sf_dir)


@query
def extract_mentions_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))
    found = mentions.extract_gazetteer(titles, language_dictionary(spark), "page_id", "title")
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("count"))


@query
def extract_mentions_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.extract_with(documents(spark, sf_dir), NumberTagger())


@query
def extract_mentions_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.extract_by_sentence(documents(spark, sf_dir), NumberTagger())


class NumberTagger:
    """Stands in for a model: numbers, scored by their length."""

    def tag(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        import re

        return [[(m, "CARDINAL", 1 / len(m)) for m in re.findall(V.NUMBER_PATTERN, text)] for text in texts]


def shown_entities(spark: SparkSession) -> DataFrame:
    """Phrases with one type each, so that a word has one right label."""
    entries = pa.table({"phrase": list(V.SHOWN), "entity_detected": list(V.SHOWN.values())})
    return spark.createDataFrame(entries)


def taught_tagger(spark: SparkSession, sf_dir: str) -> tagger.LearnedTagger:
    docs = documents(spark, sf_dir)
    return tagger.learn(docs.filter(categories.fold(F.col("id")) >= V.HELD_OUT), shown_entities(spark))


@query
def learned_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.extract_with(documents(spark, sf_dir), taught_tagger(spark, sf_dir), batch=tagger.SIDE_BY_SIDE)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query
def learned_mention_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = documents(spark, sf_dir).filter(categories.fold(F.col("id")) < V.HELD_OUT)
    return tagger.span_accuracy(tagger.labelled_texts(held, shown_entities(spark)), taught_tagger(spark, sf_dir))


@query
def mentions_without_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.extract_patterns(documents(spark, sf_dir), V.MENTION_PATTERNS, score=None)


@query
def filter_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pattern_mentions(spark, sf_dir)
    numbers = mentions.filter_mentions(found, ["PERCENT", "CARDINAL"]).withColumn("kept", F.lit("listed"))
    others = mentions.filter_mentions(found, ["PERCENT", "CARDINAL"], include=False).withColumn("kept", F.lit("rest"))
    return numbers.unionByName(others)


@query
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.filter_mentions(pattern_mentions(spark, sf_dir), ["CARDINAL"], include=False)
    return mentions.search_text(found)


@query
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.col("role").alias("search_term"), F.explode(X.tokens(F.col("text"))).alias("word"))
    return mentions.count_tokens(words)


# ---- votes and matching --------------------------------------------------------------


@query
def count_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(language_votes(spark, sf_dir))


@query
def rank_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes.rank_votes(stage(language_votes(spark, sf_dir), "votes")))


@query
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes.majority(language_votes(spark, sf_dir)))


@query
def match_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = X.match_type(X.normalize_label(F.col("p_type")), X.normalize_label(F.col("p_name")))
    turns = table(spark, sf_dir, "conversations")
    role = X.match_type(X.normalize_label(F.col("text")), F.col("role"))
    return part.select(F.col("p_partkey").alias("key"), kind.alias("match_type")).unionByName(
        turns.select(F.col("conv_id").alias("key"), role.alias("match_type"))
    )


@query
def match_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_languages(spark, sf_dir)
    return rounded(matching.match_votes(language_votes(spark, sf_dir), gold))


@query
def first_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = matching.first_match_rank(matched_languages(spark, sf_dir))
    return ranks.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query
def majority_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    leading = votes.majority(matched_languages(spark, sf_dir))
    ranks = matching.first_match_rank(leading, "majority_match")
    return ranks.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = language_ranks(spark, sf_dir)
    return ranks.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mrr(language_ranks(spark, sf_dir))


@query
def hits_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hits_at_k(language_ranks(spark, sf_dir), (1, 2, 5, 20))


def majority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leading = votes.majority(matched_languages(spark, sf_dir))
    return matching.first_match_rank(leading, "majority_match", ids=leading)


@query
def majority_hits_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hits_at_k(majority_ranks(spark, sf_dir), (1, 2, 5))


@query
def majority_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mrr(majority_ranks(spark, sf_dir))


@query
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rank_histogram(language_ranks(spark, sf_dir))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(F.col("quality") == 0)
    return labels.select(F.col("doc_id").alias("id"), F.lit("en").alias("text"))


@query
def curated_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_languages(spark, sf_dir)
    return rounded(matching.curated_overrides(matched, overrides(spark, sf_dir))).select("id", "text", "avg_score", "n_occur")


@query
def override_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.apply_overrides(matched_languages(spark, sf_dir), overrides(spark, sf_dir))
    ranks = matching.first_match_rank(matched, ids=gold_languages(spark, sf_dir))
    return ranks.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


# ---- routing, inference, evaluation -----------------------------------------------------


@query
def route_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = routing.settled_ids(language_votes(spark, sf_dir), SETTLED_MORE_THAN, SETTLED_SCORE)
    return routing.route_uncertain(gold_languages(spark, sf_dir), settled)


@query
def route_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = routing.matched_ids(matched_languages(spark, sf_dir))
    return routing.route_uncertain(gold_languages(spark, sf_dir), settled)


@query
def infer_dedup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.entity_prompt(F.col("text"), "first number"))
    return inference.infer(asked, "prompt", inference.PatternBackend(V.NUMBER_PATTERN)).select("id", "answer")


@query
def infer_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.attribute_prompt(F.col("text"), "name"))
    answered = inference.infer(asked, "prompt", inference.PatternBackend(V.NAME_PATTERN))
    return answered.select("id", X.clean_answer(F.col("answer")).alias("attribute"))


@query
def answer_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    instruction = F.concat(F.lit("Which language is this? "), F.col("text"))
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.instruction_prompt(instruction))
    answered = inference.infer(asked, "prompt", InstructionReader())
    return answered.select("id", F.col("answer").cast("bigint").alias("n_read"))


class InstructionReader:
    """Stands in for a model: says how many characters of instruction it was given."""

    name = "reader"
    model = "length"

    def answer(self, texts: list[str]) -> list[str]:
        around = len(fixed.INSTRUCTION_HEAD) + len(fixed.INSTRUCTION_TAIL)
        return [str(len(text) - around) for text in texts]


class Unsteady(inference.PatternBackend):
    """A pattern backend whose every second call fails."""

    calls = 0

    def answer(self, texts: list[str]) -> list[str]:
        Unsteady.calls += 1
        if Unsteady.calls % 2:
            raise TimeoutError("no answer this time")
        return super().answer(texts)


@query
def infer_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.entity_prompt(F.col("text"), "first number"))
    calls = inference.Calls(wait=0.001, batch=64)
    return inference.infer(asked, "prompt", Unsteady(V.NUMBER_PATTERN, name="unsteady"), calls=calls).select("id", "answer")


@query
def infer_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.entity_prompt(F.col("text"), "first number"))
    calls = inference.Calls(batch=64, min_interval=0.001, cluster_interval=0.005)
    return inference.infer(asked, "prompt", inference.PatternBackend(V.NUMBER_PATTERN), calls=calls, max_parallel=4).select("id", "answer")


@query
def infer_bucketed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.entity_prompt(F.col("text"), "first number"))
    backend, cache = inference.PatternBackend(V.NUMBER_PATTERN), answers.BucketedCache(answers.new_name(), 8)
    calls = inference.Calls(batch=64)
    inference.infer(asked.filter(F.col("gold") == "en"), "prompt", backend, cache=cache, calls=calls, waves=2)
    cache.compact(spark)
    return inference.infer(asked, "prompt", backend, cache=cache, calls=calls, waves=2).select("id", "answer")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title's first two words, beside the title: the second word is its first one at times only."""
    title = X.page_title(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return pages.select("page_id", "title", F.get(F.split("title", " "), F.lit(1)).alias("name"))


@query
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = name_pairs(spark, sf_dir)
    folded, first = names.folded(F.col("name")), F.get(F.split(names.folded(F.col("title")), " "), F.lit(0))
    similarity = names.name_similarity(F.col("name"), F.col("title"))
    return pairs.select(
        "page_id", folded.alias("folded"), names.sound_key(folded).alias("sound"), names.sound_key(first).alias("first_sound"), F.round(similarity, 6).alias("similarity")
    )


@query
def judge_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = record_to_record.judge_name_variants(name_pairs(spark, sf_dir), "name", "title", inference.CueBackend((("en", "Y."),)), 0.7, 0.5)
    return judged.select("page_id", F.round("similarity", 6).alias("similarity"), "is_first_name")


@query
def classify_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_documents(spark, sf_dir).select("id", "answer")


@query
def classify_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).withColumn("prompt", prompts.category_prompt(F.col("text"), ["DE", "ES", "FR"]))
    answered = inference.infer(asked, "prompt", inference.CueBackend(V.LANGUAGE_CUES, message=2))
    return answered.select("id", inference.keep_allowed(F.col("answer"), ["DE", "ES", "FR"]).alias("answer"))


@query
def classify_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    taught = docs.filter(categories.fold(F.col("id")) >= V.HELD_OUT)
    model = categories.learn(taught, "id", "text", "gold", categories.fold(F.col("id")) < 2 * V.HELD_OUT)
    answers = categories.classify(docs, "id", "text", model, V.LEAST_PROBABILITY)
    return answers.withColumn("held_out", categories.fold(F.col("id")) < V.HELD_OUT)


@query
def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    toxic = F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic")
    return evaluation.labels_long(labels.select("doc_id", "quality", toxic), ["doc_id"], ["quality", "toxic"])


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    second = F.when(F.col("source") == "src0", "en")
    wide = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("lang_1"), second.alias("lang_2"))
    return evaluation.labels_long(wide, ["id"], ["lang_1", "lang_2"])


@query
def mention_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mention_accuracy(language_mentions(spark, sf_dir), gold_labels(spark, sf_dir))


@query
def missed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.missed_labels(gold_labels(spark, sf_dir), language_mentions(spark, sf_dir)).select("id", "col", "label")


@query
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = classified_documents(spark, sf_dir).withColumn("answer", X.clean_answer(F.col("answer")))
    return evaluation.answer_accuracy(answers)


@query
def answer_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = classified_documents(spark, sf_dir).withColumn("answer", X.clean_answer(F.col("answer")))
    return evaluation.answer_misses(answers).select("id", "gold", "answer")


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.classification_report(classified_documents(spark, sf_dir))


@query
def error_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_review(classified_documents(spark, sf_dir)).select("id", "gold", "answer")


# ---- linking and retrieval -----------------------------------------------------------------


@query
def resolve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return linking.resolve_text(documents(spark, sf_dir), items, entry_col="item_id", entry_text_col="text")


@query
def resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_html(spark, sf_dir)
    texts = pages.select("page_id", X.page_text(F.col("html")).alias("text"))
    titles = pages.select(X.normalize_label(X.page_title(F.col("html"))).alias("title")).distinct()
    return linking.resolve_text(texts, titles, "page_id", "text", "title", "title")


@query
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_pairs(spark, sf_dir)


@query
def ambiguous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.ambiguous_pairs(stage(number_pairs(spark, sf_dir), "pairs"), ["nationkey"])


@query
def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = number_tables(spark, sf_dir)
    pairs = number_pairs(spark, sf_dir)
    return linking.pair_records(
        pairs, suppliers, customers, "s_number", "c_number", ["nationkey"], "s_suppkey", "c_custkey"
    )


def compared_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and customer records whose numbers overlap, with how far number, balance and last digit agree."""
    suppliers, customers = number_tables(spark, sf_dir)
    found = linking.pair_records(
        number_pairs(spark, sf_dir), suppliers, customers, "s_number", "c_number", ["nationkey"], "s_suppkey", "c_custkey"
    )
    held = lambda c: F.when(F.col(c) >= 0, F.floor(c))
    left = table(spark, sf_dir, "supplier").select("s_suppkey", held("s_acctbal").alias("s_held")).join(suppliers.drop("nationkey"), "s_suppkey")
    right = table(spark, sf_dir, "customer").select("c_custkey", held("c_acctbal").alias("c_held")).join(customers.drop("nationkey"), "c_custkey")
    pairs = found.select("s_suppkey", "c_custkey").join(left, "s_suppkey").join(right, "c_custkey")
    s, c = F.col("s_number"), F.col("c_number")
    apart = F.abs(F.col("s_held") - F.col("c_held"))
    compared = scoring.compare(
        pairs,
        {
            "number": scoring.agreement(s, c, F.startswith(c, s) | F.startswith(s, c), s == c),
            "balance": scoring.agreement(F.col("s_held"), F.col("c_held"), apart < 2000, apart < 200),
            "digit": scoring.agreement(F.col("s_held"), F.col("c_held"), F.col("s_held") % 10 == F.col("c_held") % 10),
        },
    )
    return stage(compared.select("s_suppkey", "c_custkey", *V.COMPARED), "compared")


@query
def learn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = compared_accounts(spark, sf_dir)
    learnt = scoring.fit(compared, V.COMPARED, V.LEARNING_ROUNDS)
    rows = [(name, k, learnt.m[name][k], learnt.u[name][k], learnt.matches) for name, n in V.COMPARED.items() for k in range(n)]
    weights = spark.createDataFrame(pa.Table.from_pylist([dict(zip(("comparison", "level", "m", "u", "matches"), r)) for r in rows]))
    seen = F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(c).cast("bigint").alias("level")) for c in V.COMPARED])).alias("x")
    n = compared.select(seen).groupBy("x.comparison", "x.level").agg(F.count(F.lit(1)).alias("n_pairs"))
    digits = [F.round(c, 6).alias(c) for c in ("m", "u", "matches")]
    return weights.join(n, ["comparison", "level"], "left").select("comparison", "level", *digits, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


@query
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = compared_accounts(spark, sf_dir)
    scored = scoring.score(compared, scoring.fit(compared, V.COMPARED, V.LEARNING_ROUNDS))
    decided = scoring.decide(scored, 0.5, 0.05)
    return decided.select("s_suppkey", "c_custkey", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "decision")


def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = X.normalize_label(X.page_title(F.col("html")))
    words = table(spark, sf_dir, "pages").select(F.explode(F.split(title, " ")).alias("word"))
    return words.filter(F.length("word") >= 4).distinct()


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(X.normalize_label(F.col("text")), " ")).alias("word"))
    return words.filter(F.length("word") >= 4).distinct()


@query
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = title_words(spark, sf_dir), item_words(spark, sf_dir)
    return fuzzy.similar_values(left, right, "word", "word", k=2)


@query
def fuzzy_pairs_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = title_words(spark, sf_dir), item_words(spark, sf_dir)
    return fuzzy.similar_values(left, right, "word", "word", k=1, hot=3)


@query
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fuzzy.similar_within(title_words(spark, sf_dir), "word", k=1)
    pairs = pairs.withColumn("weight", F.greatest(F.length("left_value"), F.length("right_value")))
    return clusters.entity_clusters(pairs, "left_value", "right_value", "weight", V.LINKED_LETTERS)


@query
def retrieve_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_pages(spark, sf_dir)


@query
def retrieve_pages_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_pages(spark, sf_dir, rare_pages=5)


@query
def retrieve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build(pages_html(spark, sf_dir))
    return ranked.retrieve(index, table(spark, sf_dir, "benchmark"), "item_id", "text", RESULTS)


@query
def guess_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = title_guess.title_results(top_pages(spark, sf_dir), pages_html(spark, sf_dir))
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.col("text").alias("search_term"))
    return title_guess.guess_title(results.join(terms, "search_id"))


# ---- flows -----------------------------------------------------------------------------------


@query
def first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matched_languages(spark, sf_dir))


def answered_languages(spark: SparkSession, sf_dir: str, matched: DataFrame) -> DataFrame:
    return text_to_entity.second_pass(
        documents(spark, sf_dir),
        matched,
        inference.CueBackend(V.LANGUAGE_CUES),
        "language of the text",
        SETTLED_MORE_THAN,
        SETTLED_SCORE,
    )


@query
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered_languages(spark, sf_dir, matched_languages(spark, sf_dir)).select("id", "gold", "answer")


@query
def cascade_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_languages(spark, sf_dir)
    first = text_to_entity.first_pass_score(matched, SETTLED_MORE_THAN, SETTLED_SCORE)
    answers = evaluation.answer_accuracy(answered_languages(spark, sf_dir, matched))
    second = answers.select(F.col("n_matches").alias("n_correct"), F.col("n_obs").alias("n_attempted"))
    return first.withColumn("step", F.lit("votes")).unionByName(second.withColumn("step", F.lit("model")))


@query
def cascade_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cascade_accuracy(cascade_passes(spark, sf_dir))
