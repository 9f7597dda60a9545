"""Quality rules, line first: bad lines go, then documents that lost too much text.

Each line with a word is held against three kinds of rule:

* punctuation: it does not end in a terminal mark (closing quotes and brackets after it allowed), or more
  than `max_marked` of its words carry two symbols in a row (`!!`, `###`, `%%%`);
* navigation: more than `max_separators` of its words are menu separators (`|`, `>`, `»`, `/`, ...);
* boilerplate: it is short, holds a stock phrase (licence, cookie, log-in, copyright lines) of one of four languages, and
  has a second sign of one: the phrase's place in the line, another phrase, a copyright sign, a year or a version.

A document is rejected when the lines that stay hold less than `min_kept` of its word characters, or when a
base rule fails (fewer than `min_words` words, or too many words in repeated five-word windows).

Defined results: a null or empty text has no words, so its base rules fail; lines without a word neither stay
nor count as lost; equal rows get equal results; doc_id may be null; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.common import released, row_bytes, shingles, word_hashes

#: Terminal marks, and what may follow one at the end of a line.
TERMINAL = ".!?:;…。！？"
CLOSING = "\"')]}”’»«"
SEPARATORS = ("|", ">", "<", "»", "«", "›", "‹", "•", "·", "/", "\\", "-", "–", "*")
#: Stock phrases by language; a line is held against those of all, as its language isn't known. Formulas seldom stand in
#: prose; calls are also ordinary words.
FORMULAS = {
    "en": ("all rights reserved", "licensed under", "released under the", "general public license", "terms of use", "terms of service", "privacy policy", "use cookies", "uses cookies", "cookie policy", "enable javascript", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "lizenziert unter", "steht unter der lizenz", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "verwenden cookies", "javascript aktivieren"),
    "fr": ("tous droits réservés", "sous licence", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "utilise des cookies", "utilisons des cookies", "activer javascript"),
    "es": ("todos los derechos reservados", "bajo licencia", "bajo la licencia", "condiciones de uso", "términos de uso", "aviso legal", "política de privacidad", "utiliza cookies", "utilizamos cookies", "activar javascript"),
}
CALLS = {
    "en": ("subscribe to", "sign in", "log in", "copyright", "click here", "read more", "powered by"),
    "de": ("newsletter abonnieren", "melden sie sich an", "impressum", "hier klicken", "klicken sie hier", "weiterlesen", "mehr lesen"),
    "fr": ("abonnez-vous", "connectez-vous", "se connecter", "cliquez ici", "lire la suite", "en savoir plus"),
    "es": ("suscríbete", "suscríbase", "iniciar sesión", "inicia sesión", "haga clic aquí", "haz clic aquí", "leer más"),
}


def _any(*kinds: dict) -> str:
    return "(?:" + "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for kind in kinds for phrases in kind.values() for p in phrases) + ")"


_GAP, _TEXT, _PLAIN = r"[ \t-\r]", r"[^ \t-\r]", r"[\x01-\x40\x5b-\x60\x7b-\x7f]"
#: A phrase alone doesn't condemn a line. The second sign is where it stands (a formula after three words at most, a call at
#: the line's beginning), a second phrase, or with a formula a copyright sign, a year, a version or a licence's name.
BOILERPLATE = "|".join((
    f"^{_GAP}*(?:{_TEXT}+{_GAP}+){{0,3}}{_PLAIN}*{_any(FORMULAS)}", f"^{_PLAIN}*{_any(CALLS)}", f"{_any(FORMULAS, CALLS)}.*{_any(FORMULAS, CALLS)}",
    *(f"{x}.*{y}" for a, b in ((_any(FORMULAS), r"(?:©|\(c\)|(?:19|20)[0-9][0-9]|[0-9]\.[0-9]|cc.by|cc0|creative commons|gnu|apache)"),) for x, y in ((a, b), (b, a))),
))
_MARKED = re.compile(rb"[!?.,;:#*$%&|<>~=_+^@-]{2}")
_BOILERPLATE = re.compile(BOILERPLATE.encode())
_PHRASE = re.compile(_any(FORMULAS, CALLS).encode())
_SEPARATORS = frozenset(x.encode() for x in SEPARATORS)
_TERMINAL = frozenset(TERMINAL)
_WHITE = b" \t\n\x0b\x0c\r"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_WHITE)] = True


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_marked: float = 0.3
    max_separators: float = 0.2
    boilerplate_words: int = 25
    min_kept: float = 0.5


def line_fails(line: bytes, words: list[bytes], rules: QualityRules) -> str | None:
    """The kind of rule that a line with words fails, or None."""
    size = 64
    while not (end := line[-size:].decode("utf-8", "ignore").rstrip(CLOSING)) and size < len(line):
        size *= 4  # closing marks only so far
    if end[-1:] not in _TERMINAL:
        return "punctuation"
    n = len(words)
    if _MARKED.search(line) and sum(1 for w in words if _MARKED.search(w)) > rules.max_marked * n:
        return "punctuation"
    if sum(map(_SEPARATORS.__contains__, words)) > rules.max_separators * n:
        return "navigation"
    if n <= rules.boilerplate_words and _PHRASE.search(low := line.lower()) and _BOILERPLATE.search(low):
        return "boilerplate"
    return None


def repeated_words(text: bytes, window: int) -> tuple[int, int]:
    """Words, and those of them in windows that the text holds twice or more."""
    words = word_hashes(text)
    n = len(words)
    if n <= window:
        return n, 0
    grams = shingles(words, window)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return n, 0
    at = np.searchsorted(twice, grams)
    again = twice[np.minimum(at, len(twice) - 1)] == grams
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return n, int((np.cumsum(edge[:-1]) > 0).sum())


def word_chars(text: bytes) -> int:
    """Code points that are not white space."""
    a = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((a & 0xC0) != 0x80) - np.count_nonzero(_IS_SPACE[a]))


def assess(text: bytes, rules: QualityRules, texts: bool = True) -> tuple:
    chars = word_chars(text)
    symbols = int(np.count_nonzero(_IS_SYMBOL[np.frombuffer(text, np.uint8)]))
    n, repeat = repeated_words(text, rules.window)
    seen: set[bytes] = set()
    duplicate = removed = lost = 0
    kept_lines = []
    for line in text.split(b"\n"):
        words = line.split()  # of bytes: at [\x20\x09-\x0D] only
        if words:
            if line in seen:
                duplicate += 1
            else:
                seen.add(line)
            if line_fails(line.strip(_WHITE), words, rules):
                removed += 1
                lost += word_chars(line)
                continue
        kept_lines.append(line)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not failed and chars - lost >= rules.min_kept * chars
    figures = n, chars, symbols, duplicate, repeat, failed, kept, removed, chars - lost
    return (*figures, b"\n".join(kept_lines).decode("utf-8", "replace")) if texts else figures


_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("n_removed_lines", pa.int64()), ("kept_chars", pa.int64()), ("clean_text", pa.string()),
]
_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_removed_lines long, kept_chars long"
)


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), texts: bool = True, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns in `carry`, the base figures, the verdict and, with `texts`, the text
    without its failed lines (`clean_text`). One pass without a shuffle; a task holds one Arrow batch."""
    names = [*carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [assess(t or b"", rules, texts) for t in row_bytes(b.column("_text"))]
            columns = list(zip(*rows, strict=True)) or [()] * (len(_FIELDS) - (not texts))
            made = [pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), *made], [*names, *(f for f, _ in _FIELDS[: len(made)])]
            )

    source = docs.select(*names, F.col("text").alias("_text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), _DDL] + ["clean_text string"] * texts)
    return source.mapInArrow(released(run), ddl)
