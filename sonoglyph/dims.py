"""Fixed tables of the speech domain, as plain values in natural order."""

from __future__ import annotations

# Symbols of the default phoneme alphabet; a symbol's place is its id. The first three pad, begin and end.
PHONEMES = [
    "_", "^", "$", " ", "!", "'", "(", ")", ",", "-", ".", ":", ";", "?", "a", "b", "c", "d", "e", "f", "h", "i", "j", "k", "l", "m", "n", "o", "p",
    "q", "r", "s", "t", "u", "v", "w", "x", "y", "z", "æ", "ç", "ð", "ø", "ħ", "ŋ", "œ", "ǀ", "ǁ", "ǂ", "ǃ", "ɐ", "ɑ", "ɒ", "ɓ", "ɔ", "ɕ", "ɖ", "ɗ",
    "ɘ", "ə", "ɚ", "ɛ", "ɜ", "ɞ", "ɟ", "ɠ", "ɡ", "ɢ", "ɣ", "ɤ", "ɥ", "ɦ", "ɧ", "ɨ", "ɪ", "ɫ", "ɬ", "ɭ", "ɮ", "ɯ", "ɰ", "ɱ", "ɲ", "ɳ", "ɴ", "ɵ", "ɶ",
    "ɸ", "ɹ", "ɺ", "ɻ", "ɽ", "ɾ", "ʀ", "ʁ", "ʂ", "ʃ", "ʄ", "ʈ", "ʉ", "ʊ", "ʋ", "ʌ", "ʍ", "ʎ", "ʏ", "ʐ", "ʑ", "ʒ", "ʔ", "ʕ", "ʘ", "ʙ", "ʛ", "ʜ", "ʝ",
    "ʟ", "ʡ", "ʢ", "ʲ", "ˈ", "ˌ", "ː", "ˑ", "˞", "β", "θ", "χ", "ᵻ", "ⱱ", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "̧", "̃", "̪", "̯", "̩",
    "ʰ", "ˤ", "ε", "↓", "#", '"', "↑", "̺", "̻", "g", "ʦ", "X", "̝", "̊",
]
# The Ukrainian alphabet, likewise.
PHONEMES_UK = [
    "_", "^", "$", " ", "!", "'", ",", "-", ".", ":", ";", "?", "а", "б", "в", "г", "ґ", "д", "е", "є", "ж", "з", "и", "і", "ї", "й", "к", "л", "м",
    "н", "о", "п", "р", "с", "т", "у", "ф", "х", "ц", "ч", "ш", "щ", "ь", "ю", "я", "́", "̆", "̈", "—",
]
PAD, BEGIN, END = 0, 1, 2

# Punctuation and what it is written as.
PUNCTUATION = {
    "。": ". ", "，": ", ", "、": ", ", "：": ": ", "；": "; ", "？": "? ", "！": "! ", "（": "(", "）": ")", "【": "[", "】": "]",
    "［": "[", "］": "]", "｛": "{", "｝": "}", "「": '"', "」": '"', "『": '"', "』": '"', "《": '"', "》": '"', "〈": '"', "〉": '"',
    "…": "...", "‥": "..", "—": "-", "–": "-", "―": "-", "〜": "~", "～": "~", "・": "-", "·": "-", "．": ". ", "،": ",", "؛": ";",
    "؟": "?", "।": ".", "॥": "..", "׳": "'", "״": '"', "／": "/", "＼": "\\", "％": "%", "＋": "+", "－": "-", "＝": "=", "＆": "&",
    "＃": "#", "＠": "@", "｜": "|",
}

# Codes of the supported languages and their names.
LANGUAGES = {"zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "fr": "French", "de": "German", "ru": "Russian", "pt": "Portuguese", "es": "Spanish", "it": "Italian"}
# Longer codes of the same languages.
LONG_CODES = {"zho": "zh", "eng": "en", "jpn": "ja", "kor": "ko", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "por": "pt", "spa": "es", "ita": "it"}

# Languages by script, where several share one.
SCRIPT_LANGUAGES = {
    "Latin": ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "cs", "sk", "hu", "ro", "hr", "sl", "fi", "sv", "no", "da", "is", "et", "lv", "lt", "mt", "sq", "tr", "az", "uz", "vi", "id", "ms", "tl", "sw", "af", "eu", "ca", "gl", "cy", "ga", "gd", "br", "eo", "la"],
    "Cyrillic": ["ru", "uk", "bg", "sr", "mk", "be", "kk", "ky", "mn", "tg"],
    "Arabic": ["ar", "fa", "ur", "ps", "sd", "ug"],
    "Devanagari": ["hi", "mr", "ne", "sa", "bh"],
    "Han": ["zh", "ja"],
}
# Least confidence in the detected language and most in the main one, by script and by languages that are easily confused.
SCRIPT_THRESHOLDS = {"Han": (0.97, 0.03), "Cyrillic": (0.85, 0.08), "Arabic": (0.85, 0.08), "Devanagari": (0.85, 0.08), "Latin": (0.7, 0.1)}
CONFUSABLE = [(["no", "da", "sv", "nn", "nb"], (0.97, 0.03)), (["nl", "af"], (1.0, 0.0)), (["id", "ms"], (0.97, 0.03)), (["es", "pt", "ca", "gl"], (0.85, 0.08))]
DEFAULT_THRESHOLD = (0.7, 0.1)

# Words that a sentence does not end with.
INCOMPLETE_ENDINGS = [
    "a", "an", "and", "as", "at", "because", "but", "by", "for", "from", "if", "in", "including", "into", "like", "of", "on", "or", "that", "the",
    "to", "when", "where", "which", "while", "with", "without",
]
# Expressiveness, temperature, top k, repetition penalty.
EXPRESSIVENESS = [(1.0, 0.90, 50, 1.03), (0.8, 0.84, 48, 1.035), (0.6, 0.78, 46, 1.04), (0.4, 0.72, 44, 1.045), (0.2, 0.66, 42, 1.05), (0.0, 0.60, 40, 1.055)]

# Named scripts that text is parted by; of other scripts each character is a run.
SCRIPTS = [
    "Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Hebrew", "Greek", "Thai", "Devanagari", "Bengali", "Tamil", "Telugu",
    "Gujarati", "Kannada", "Malayalam", "Myanmar", "Khmer", "Lao", "Sinhala", "Ethiopic", "Georgian", "Armenian",
]

# Scripts and characters that settle a language, in the order in which they are looked for.
MARKERS = [
    ("ja", ["Hiragana", "Katakana"], "峠畑辻込笹栃榊円"), ("ko", ["Hangul"], ""), ("th", ["Thai"], ""), ("uk", [], "їєґЇЄҐ"),
    ("sr", [], "ђјљњћџЂЈЉЊЋЏ"), ("bg", [], "ъЪ"), ("el", ["Greek"], ""), ("he", ["Hebrew"], ""), ("ta", ["Tamil"], ""), ("te", ["Telugu"], ""),
    ("bn", ["Bengali"], ""), ("gu", ["Gujarati"], ""), ("kn", ["Kannada"], ""), ("ml", ["Malayalam"], ""), ("my", ["Myanmar"], ""),
    ("km", ["Khmer"], ""), ("lo", ["Lao"], ""), ("si", ["Sinhala"], ""), ("am", ["Ethiopic"], ""), ("ka", ["Georgian"], ""), ("hy", ["Armenian"], ""),
]
# Languages of Latin script whose detection is trusted.
COMMON_LATIN = [
    "en", "de", "fr", "es", "pt", "it", "nl", "pl", "cs", "sk", "hu", "ro", "hr", "sl", "sv", "no", "da", "fi", "et", "lv", "lt", "is", "ga", "cy",
    "eu", "ca", "gl", "sq", "mt", "id", "ms", "tl", "vi", "tr", "sw", "af", "eo", "la",
]
# Languages that detectors take short Latin text for and that are never trusted.
BANNED_LATIN = [
    "tlh", "vo", "ia", "ie", "wo", "sn", "st", "xh", "zu", "ny", "ig", "yo", "ha", "rw", "lg", "ak", "om", "aa", "rn", "ve", "ss", "sg", "nso", "nr",
    "ts", "tn", "ln", "sm", "haw", "to", "fj", "bi", "na", "mi", "hmn", "kha", "za", "su", "jw", "ht", "mfe", "crs", "gn", "qu", "ay", "gv", "br",
    "rm", "gd", "sco", "kl", "fo", "oc", "co", "fy", "lb", "so", "mg", "ceb", "war", "sa", "tt", "tk", "uz",
]
# The locale of each supported language.
LOCALES = {"zh": "zh-CN", "en": "en-US", "ja": "ja-JP", "ko": "ko-KR", "fr": "fr-FR", "de": "de-DE", "ru": "ru-RU", "pt": "pt-PT", "es": "es-ES", "it": "it-IT"}
