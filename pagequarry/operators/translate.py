"""Translation of record fields, gated by the language that is detected."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TranslationError
from ..functions.languages import language_code
from ..functions.text import trim_u
from ..sources.tables import stored
from .movie import LISTS, STRINGS

CONFIDENCE = 0.6
Detect = Callable[[str], tuple[str, float]]
Translate = Callable[[list[str]], list[str]]
# Fields that can be translated; names compare without punctuation and case.
KEYS = ("title", "originaltitle", "sorttitle", "director", "credits", "genre", "tag", "plot", "outline", "tagline", "studio", "country", "set.name", "set.overview", "actor.name", "actor.role", "actor.gender", "trailer", "fileinfo", "dateadded")
ALIASES = {"set": "set.name", "actor": "actor.name"}
# Frequent words of languages, for the detector that is built in.
WORDS = {
    "eng": "the of and to in is that it was for on are with as his they at be this from have by not but what all were when your can said there".split(),
    "fra": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont la avec son aux mais nous".split(),
    "deu": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "spa": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre".split(),
}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve_keys(names: list[str]) -> list[str]:
    """The fields that names mean, once each; an unknown one raises. None means that nothing is translated."""
    known = {_plain(k): k for k in KEYS} | ALIASES
    out = []
    for n in names:
        if _plain(n) not in known:
            raise TranslationError(f"unknown field {n!r}")
        out.append(known[_plain(n)])
    return list(dict.fromkeys(out))


def detect_words(text: str) -> tuple[str, float]:
    """The language whose frequent words the text holds most of, with their share among all such words."""
    words = re.findall(r"\w+", text.lower())
    hits = {lang: sum(map(set(own).__contains__, words)) for lang, own in WORDS.items()}
    total, best = sum(hits.values()), max(hits, key=hits.get)
    return (best, hits[best] / total) if total else ("und", 0.0)


def needs(text: str | None, target: str, detect: Detect) -> bool:
    """Whether a text is to be translated: not blank, and not surely in the target language."""
    if not text or not text.strip():
        return False
    lang, sure = detect(text.strip())
    return not (lang == target and sure >= CONFIDENCE)


MAX_TEXTS, MAX_BYTES = 50, 20_000  # of one request


def _values(movie: Column, keys: list[str]) -> Column:
    """The texts that keys name, trimmed, in one array."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    parts = [F.array().cast("array<string>")]
    for key in keys:
        if key in STRINGS:
            parts.append(F.array(movie[key]))
        elif key in LISTS:
            parts.append(some(movie[key]))
        elif key.startswith("set."):
            parts.append(F.array(movie["set"][key[4:]]))
        else:
            parts.append(some(_of_actors(movie, key[6:])))
    return F.transform(F.filter(F.concat(*parts), lambda x: x.isNotNull()), lambda x: trim_u(x))


def _of_actors(movie: Column, name: str) -> Column:
    return F.transform(movie["actor"], lambda a: a[name])


def _replaced(movie: Column, keys: list[str], new: Callable[[Column], Column]) -> Column:
    """The record with new(text) in the places that keys name."""
    for key in (k for k in keys if k in STRINGS):
        movie = movie.withField(key, new(movie[key]))
    for key in (k for k in keys if k in LISTS):
        movie = movie.withField(key, F.transform(movie[key], new))
    for name in (k[4:] for k in keys if k.startswith("set.")):
        movie = movie.withField("set", F.when(movie["set"].isNotNull(), movie["set"].withField(name, new(movie["set"][name]))))
    if actor := [k[6:] for k in keys if k.startswith("actor.")]:

        def one(a: Column) -> Column:
            for name in actor:
                a = a.withField(name, new(a[name]))
            return a

        movie = movie.withField("actor", F.transform(movie["actor"], one))
    return movie


def requests(texts: Iterator[str], max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> Iterator[list[str]]:
    """Texts in lists of at most so many texts and bytes; a longer text goes alone."""
    held: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode())
        if held and (len(held) >= max_texts or size + n > max_bytes):
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def answered(texts: DataFrame, target: str, translate: Translate, detect: Detect = detect_words, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """text and answer of each different text that is to be translated; texts: one column, repeats and nulls allowed.

    Texts are made distinct before they are looked at, so each goes out once, in requests
    bounded in texts and bytes. A request is made again if its task is.
    """
    import pyarrow as pa

    def run(batches):
        wanted = (t for batch in batches for t in batch.column(0).to_pylist() if needs(t, target, detect))
        for sent in requests(wanted, max_texts, max_bytes):
            answers = translate(sent)
            if len(answers) != len(sent):
                raise TranslationError(f"{len(sent)} texts went out, {len(answers)} came back")
            yield pa.RecordBatch.from_arrays([pa.array(sent, pa.string()), pa.array([(x or "").strip() for x in answers], pa.string())], ["text", "answer"])

    return texts.toDF("text").where("text <> ''").distinct().mapInArrow(run, "text string, answer string")


def translate_movies(
    df: DataFrame, keys: list[str], target: str, translate: Translate, detect: Detect = detect_words, movie_col: str = "movie", max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """df with its records translated and a column changed; untouched but for that without keys.

    Rows and answers are written to the shared folder, so that services are asked once
    however often the result is read; answers return by a join on the text, and the places
    of a record take theirs from a map of its own texts. Null records stay null.
    """
    fields, code = resolve_keys(keys), language_code(target)
    if not fields:
        return df.withColumn("changed", F.lit(False))
    row, found = (next(n for n in (base + "_" * k for k in range(99)) if n not in df.columns) for base in ("row", "found"))
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(row, F.explode(F.array_distinct(_values(F.col(movie_col), fields))).alias("text"))
    answers = stored(answered(texts.select("text"), code, translate, detect, max_texts, max_bytes))
    maps = texts.join(answers, "text").where("answer <> '' and answer <> text").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("text", "answer"))).alias(found))
    new = lambda t: F.coalesce(F.try_element_at(F.col(found), trim_u(t)), t)
    changed = F.col(found).isNotNull()
    return rows.join(maps, row, "left").select(
        *[F.when(changed, _replaced(F.col(n), fields, new)).otherwise(F.col(n)).alias(n) if n == movie_col else F.col(n) for n in df.columns], changed.alias("changed")
    )


# Answers of translation services


def _fenced(text: str) -> str:
    m = re.fullmatch(r"\s*```[\w-]*\n(.*?)\n?```\s*", text, re.S)
    return (m[1] if m else text).strip()


def chat_answer(body: str) -> str:
    """The message of a chat completion, without a code fence around it."""
    try:
        return _fenced(json.loads(body)["choices"][0]["message"]["content"])
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise TranslationError(f"unexpected chat answer: {e}") from None


def cloud_answer(body: str) -> list[str]:
    try:
        return [t["translatedText"] for t in json.loads(body)["data"]["translations"]]
    except (KeyError, TypeError, ValueError) as e:
        raise TranslationError(f"unexpected answer: {e}") from None


def segment_answer(body: str) -> str:
    """Segments of the free form, joined."""
    try:
        return "".join(s[0] for s in json.loads(body)[0] if s and s[0])
    except (IndexError, TypeError, ValueError) as e:
        raise TranslationError(f"unexpected answer: {e}") from None


def texts_answer(body: str) -> list[str]:
    try:
        return [t["text"] for t in json.loads(body)["translations"]]
    except (KeyError, TypeError, ValueError) as e:
        raise TranslationError(f"unexpected answer: {e}") from None


# Tags of the services and the name of the key that each wants.
ENDPOINTS = {"openai": ("api-key", chat_answer), "google": ("api_key", cloud_answer), "google-free": (None, segment_answer), "deep-l": ("auth_key", texts_answer)}


def endpoint(kind: str, send: Callable[[str, list[str]], list[str]] | None = None) -> Translate:
    """A service by its tag. Nothing is sent from here: send(kind, texts) has to do it and give the answers' bodies."""
    if kind not in ENDPOINTS:
        raise TranslationError(f"unknown endpoint {kind!r}")
    if send is None:
        from ..errors import NotEnabled

        raise NotEnabled(f"endpoint {kind!r} needs a network")
    read = ENDPOINTS[kind][1]

    def translate(texts: list[str]) -> list[str]:
        out: list[str] = []
        for body in send(kind, texts):
            got = read(body)
            out += got if isinstance(got, list) else [got]
        return out

    return translate
