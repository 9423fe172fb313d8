"""Lexical normalisation, expansion, weighting and query keys, as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical resources that recall results depend on.
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "with", "of", "to", "in", "on"]
PLURALS = {
    "paths": "path",
    "models": "model",
    "lookups": "lookup",
    "transactions": "transaction",
    "embeddings": "embedding",
    "indexes": "index",
    "indices": "index",
    "queries": "query",
    "vectors": "vector",
    "representations": "representation",
    "results": "result",
}
SYNONYMS = [
    ("second pass", ["re ranking", "reranking"]),
    ("rerank", ["re ranking", "reranking"]),
    ("cache", ["caching", "redis"]),
    ("temporary lookup", ["cache", "caching", "redis"]),
    ("frequency closeness", ["resonance recall", "resonance similarity"]),
    ("read write path", ["cqrs", "command query responsibility segregation"]),
    ("separate read write", ["cqrs", "command query responsibility segregation"]),
    ("command query", ["cqrs", "command query responsibility segregation"]),
    ("similarity search", ["approximate nearest neighbor", "nearest neighbor"]),
]
ORIGINAL_WEIGHT, EXPANSION_WEIGHT = 1.0, 0.25


@dataclass(frozen=True)
class Lexicon:
    stop_words: Sequence[str] = tuple(STOP_WORDS)
    plurals: Mapping[str, str] | None = None
    synonyms: Sequence[tuple[str, Sequence[str]]] = tuple(SYNONYMS)

    def plural_map(self) -> Column:
        pairs = dict(PLURALS if self.plurals is None else self.plurals)
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.expr("map()").cast("map<string,string>")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{Alnum}]+"), lambda x: x != "")


def normalized_tokens(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Tokens with plurals mapped, then without stop words."""
    plural = lexicon.plural_map()
    stops = F.array(*map(F.lit, lexicon.stop_words)) if lexicon.stop_words else F.array().cast("array<string>")
    return F.filter(F.transform(tokens(text), lambda x: F.coalesce(F.try_element_at(plural, x), x)), lambda x: ~F.array_contains(stops, x))


def normalized(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    return F.array_join(normalized_tokens(text, lexicon), " ")


def has_phrase(norm: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {phrase} ")


def expansions(norm: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Expansions of the phrases that occur, in the lexicon's order, each string once."""
    parts = [F.when(has_phrase(norm, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in lexicon.synonyms]
    return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")


def enriched(norm: Column, exp: Column) -> Column:
    """Normalised text and expansions, joined by blanks."""
    return F.trim(F.concat_ws(" ", F.when(norm != "", norm), exp))


def weighted(norm: Column, exp: Column, original: float = ORIGINAL_WEIGHT, expansion: float = EXPANSION_WEIGHT) -> Column:
    """array<struct<token, weight>>; multi-word expansions are split again, repeated tokens stay."""
    pair = lambda w: lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight"))
    return F.concat(F.transform(tokens(norm), pair(original)), F.transform(F.flatten(F.transform(exp, tokens)), pair(expansion)))


def alias_weights(expansion: float = EXPANSION_WEIGHT) -> tuple[float, float]:
    """Weights of an alias and of what it expands to."""
    return expansion, min(expansion, expansion * expansion)


def weighted_atom(content: Column, aliases: Column, lexicon: Lexicon = Lexicon(), expansion: float = EXPANSION_WEIGHT) -> Column:
    """array<struct<source, token, weight>> of content, its expansions, aliases and theirs."""
    first, second = alias_weights(expansion)
    tag = lambda s, w: lambda t: F.struct(F.lit(s).alias("source"), t.alias("token"), F.lit(float(w)).alias("weight"))
    split_all = lambda exp: F.flatten(F.transform(exp, tokens))
    norm = normalized(content, lexicon)
    own = F.coalesce(aliases, F.array().cast("array<string>"))
    return F.concat(
        F.transform(tokens(norm), tag("ORIGINAL", ORIGINAL_WEIGHT)),
        F.transform(split_all(expansions(norm, lexicon)), tag("EXPANSION", expansion)),
        F.transform(F.flatten(F.transform(own, lambda a: tokens(normalized(a, lexicon)))), tag("ALIAS", first)),
        F.transform(F.flatten(F.transform(own, lambda a: split_all(expansions(normalized(a, lexicon), lexicon)))), tag("ALIAS_EXPANSION", second)),
    )


def searchable(content: Column, aliases: Column) -> Column:
    return F.concat_ws(" ", content, aliases)


def projection_text(summary: Column, solution: Column, lesson: Column) -> Column:
    """Lines of what is present."""
    return F.concat_ws("\n", summary, solution, lesson)


def _terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def exact_key(query: Column) -> Column:
    return query


def normalized_key(query: Column, lexicon: Lexicon = Lexicon()) -> Column:
    norm = normalized(query, lexicon)
    return F.when(F.trim(norm) == "", query).otherwise(F.concat(F.lit("normalized:"), norm))


def lexical_key(query: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Sorted distinct terms of the expansions; without any, of the whole enriched text; without those, the query."""
    norm = normalized(query, lexicon)
    exp = expansions(norm, lexicon)
    own, every = _terms(F.concat_ws(" ", exp)), _terms(enriched(norm, exp))
    return (
        F.when(F.size(own) > 0, F.concat(F.lit("lexical-expansion:"), F.array_join(own, " ")))
        .when(F.size(every) > 0, F.concat(F.lit("lexical:"), F.array_join(every, " ")))
        .otherwise(query)
    )


def expand_query(query: Column, rules: Sequence[tuple[str, Sequence[str]]], cap: int) -> Column:
    """struct<text, added, truncated>: terms of whole-token rules in table order, no chaining, at most *cap* terms."""
    norm = F.array_join(tokens(query), " ")
    parts = [F.when(has_phrase(norm, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in rules]
    found = F.array_except(F.array_distinct(F.flatten(F.array(*parts))), tokens(query))
    added = F.slice(found, 1, cap)
    return F.struct(F.concat_ws(" ", query, added).alias("text"), added.alias("added"), (F.size(found) > cap).alias("truncated"))


def alias_gap(query: Column, labels: Column) -> Column:
    """No token of the query occurs in any label."""
    split = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")
    return ~F.arrays_overlap(split(query), F.flatten(F.transform(labels, split)))


def fingerprint(lexicon: Lexicon = Lexicon()) -> str:
    """SHA-256 over the sorted resources: the identity of a lexical configuration."""
    import hashlib

    plurals = dict(PLURALS if lexicon.plurals is None else lexicon.plurals)
    lines = [*(f"stop\t{w}" for w in sorted(lexicon.stop_words)), *(f"plural\t{k}\t{v}" for k, v in sorted(plurals.items())), *(f"synonym\t{k}\t{','.join(v)}" for k, v in lexicon.synonyms)]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
