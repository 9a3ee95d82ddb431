"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: One hit rejects.
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "sportsbook", "payday-loan", "cheap-pills", "spam-farm", "warez", "malware", "phishing")
#: Several distinct hits reject.
SOFT = ("adult", "bet", "bonus", "cheap", "click", "crack", "deal", "free", "gift", "jackpot", "loan", "pills", "poker", "promo", "sale", "sex", "spam", "win")
#: Distinct soft terms that reject.
SOFT_LIMIT = 2
#: (host, path, verdict): the rule fits the host, its subdomains and paths that start with the path; the longest rule wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    ends = [i for c in "?#" if (i := path.find(c)) >= 0]
    return host.translate(_LOWER), path[: min(ends, default=len(path))]


class RuleTable:
    """Rules by host; a URL looks up its host and each parent domain."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and len(host + start) > len(best[0] or ""):
                    best = (host + start, verdict)
            host = host.partition(".")[2]
        return best


class Vocabulary:
    """Aho-Corasick automaton over strict and soft terms; a hit counts between characters that are no ASCII letter or digit."""

    def __init__(self, strict, soft, soft_limit: int):
        import ahocorasick

        self.soft_limit, self.strict, self.auto = soft_limit, frozenset(strict), ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.auto.add_word(term, term)
        self.auto.make_automaton()

    @staticmethod
    def _inside(c: str) -> bool:
        return c.isascii() and c.isalnum()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms."""
        low = url.translate(_LOWER)
        strict, soft = set(), set()
        for end, term in self.auto.iter(low):
            at = end - len(term)
            if (at >= 0 and self._inside(low[at])) or (end + 1 < len(low) and self._inside(low[end + 1])):
                continue
            (strict if term in self.strict else soft).add(term)
        return strict, soft

    def rejects(self, strict: set[str], soft: set[str]) -> bool:
        return bool(strict) or len(soft) >= self.soft_limit


def url_filter(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms of every row of pages (page_id, url, ...).

    verdict is the fitting rule's, else block when the vocabulary rejects the URL, else allow.
    A null URL or one without '://' has an empty host and path, fits no rule and is still read by the
    vocabulary (null: no hit). Repeated rows and null page_ids keep their rows; extra columns are ignored, whatever their names.
    URLs of any length are read whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = RuleTable(rules), Vocabulary(strict, soft, soft_limit)
        for b in batches:
            rows = []
            for x in b.column("url"):
                url = x.as_py()
                host, path = split_url(url)
                rule, verdict = table.find(host, path)
                hard, mild = words.hits(url or "")
                rows.append((host, path, rule, verdict or ("block" if words.rejects(hard, mild) else "allow"), len(hard), len(mild)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_terms int, soft_terms int"
    )
