"""Language markers of subtitle names, and language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TranslationError

# Markers (two words, then one) and the tag that each stands for, the first that fits winning.
PAIRS = {
    "zh cn": "zh-CN", "zh hans": "zh-CN", "zh tw": "zh-TW", "zh hant": "zh-TW", "zh hk": "zh-HK", "en us": "en-US", "en gb": "en-GB",
    "pt br": "pt-BR", "pt pt": "pt-PT",
}
WORDS = {
    "zhcn": "zh-CN", "zhtw": "zh-TW", "zhhk": "zh-HK", "zhhans": "zh-CN", "zhhant": "zh-TW", "enus": "en-US", "engb": "en-GB", "ptbr": "pt-BR",
    "ptpt": "pt-PT", "zh": "zh-CN", "chs": "zh-CN", "cht": "zh-TW", "ch": "zh-CN", "en": "en", "eng": "en", "ja": "ja", "jp": "ja", "jpn": "ja",
    "ko": "ko", "kr": "ko", "kor": "ko", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es",
    "it": "it", "ita": "it", "pt": "pt", "por": "pt", "ru": "ru", "rus": "ru", "ar": "ar", "ara": "ar", "th": "th", "tha": "th", "vi": "vi",
    "vie": "vi", "id": "id", "ind": "id", "ms": "ms", "msa": "ms", "tr": "tr", "tur": "tr", "nl": "nl", "nld": "nl", "dut": "nl", "sv": "sv",
    "swe": "sv", "no": "no", "nor": "no", "da": "da", "dan": "da", "fi": "fi", "fin": "fi", "pl": "pl", "pol": "pl", "cs": "cs", "ces": "cs",
    "cze": "cs", "hu": "hu", "hun": "hu", "ro": "ro", "ron": "ro", "rum": "ro", "el": "el", "ell": "el", "gre": "el", "he": "he", "heb": "he",
    "hi": "hi", "hin": "hi", "uk": "uk", "ukr": "uk", "bg": "bg", "bul": "bg", "sr": "sr", "srp": "sr", "hr": "hr", "hrv": "hr",
}
# Two-letter codes that a target language may be given in.
ISO_639_1 = {"en": "eng", "zh": "cmn", "ja": "jpn", "ko": "kor", "fr": "fra", "de": "deu", "es": "spa", "ru": "rus"}
ISO_639_3 = frozenset(
    "epo eng rus cmn spa por ita ben fra deu ukr kat ara hin jpn heb yid pol amh jav kor nob dan swe fin tur nld hun ces ell bul bel mar kan ron slv hrv srp mkd lit lav est tam vie urd tha guj uzb pan aze ind tel pes mal ori mya nep sin khm tuk aka zul sna afr lat slk cat tgl hye".split()
)


def language_prefix(lower_tokens: Column) -> Column:
    """struct(language, consumed) of the marker that the lower-cased words begin with; null and 0 without one."""
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    pair = F.try_element_at(table(PAIRS), F.concat_ws(" ", F.slice(lower_tokens, 1, 2)))
    word = F.try_element_at(table(WORDS), F.coalesce(F.get(lower_tokens, F.lit(0)), F.lit("")))
    return F.struct(F.coalesce(pair, word).alias("language"), F.when(pair.isNotNull(), 2).when(word.isNotNull(), 1).otherwise(0).alias("consumed"))


def language_code(text: str) -> str:
    """The three-letter code that a target language means: as it is, or of the part before - or _."""
    code = text.strip().lower()
    base = code.replace("_", "-").split("-")[0]
    for x in (code, base):
        if x in ISO_639_3:
            return x
    if base in ISO_639_1:
        return ISO_639_1[base]
    raise TranslationError(f"unknown target language {text!r}")
