"""Secrets in texts: fixed patterns, and strings that a primed compressor finds novel."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of spans that start together.
KINDS = ("assign", "access", "hex", "novel")

#: Fixed values of the secrets contract: pattern, group whose length counts, least length.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words near which a string may be a secret; looked for in lower case.
CONTEXT_WORDS = (*_WORDS, "credential", "private", "auth", "bearer", "signature", "passphrase", "access key", "access_key", "-key", "_key")
#: Identifiers and phrases that surround secrets in code and settings: they cost the primed
#: compressor next to nothing.
IDENTIFIERS = (
    "password passwd passphrase secret secretKey secret_key client_secret token accessToken access_token refresh_token auth_token "
    "api_key apiKey API_KEY credential credentials authorization Authorization: Bearer Basic private_key privateKey public_key "
    "username user_name user_id account_id session_id client_id tenant_id config configuration settings environment variable "
    "getenv os.environ process.env export const let var def return function class import from include public static final String "
    "string int boolean true false null none undefined localhost 127.0.0.1 example.com http:// https:// github.com database "
    "connection connectionString server hostname port timeout retry version default production staging development test "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef "
)
#: Words of prose, of settings and of identifiers that the dictionaries are made of.
VOCABULARY = (
    "the and that have with this from they would there what about which when make like time just know take people into year good some could other than then look only come over think "
    "also back after work first well way even new want because these give day most under very much each where "
    "tion ment ness able ible ence ance ing ated ations ality ively graph ization ional ical ious ether ough ight ould inter trans super micro multi auto "
    "test case class object value name index list array string number type data file path line text word item node tree link page user group role account order product price total count "
    "size length width height color image message event handler listener manager service factory builder provider controller helper parser reader writer stream buffer cache queue stack thread process signal "
    "socket request response header body method function module package import return result error exception warning status state start stop open close read write create update delete insert remove find search "
    "password passwd secret token access key private public auth credential bearer config settings database server host port client session default production version environment"
)
#: Ways in which words are joined, one of which each sample of the dictionaries shows.
_STYLES = (lambda w: "".join(map(str.title, w)), lambda w: w[0] + "".join(map(str.title, w[1:])), "_".join, lambda w: "_".join(w).upper(), "-".join, " ".join)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{15,}")  # may follow a "="
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: How far before a candidate a context word may end, and how much text on either side primes the compressor.
REACH, AROUND = 40, 1000
#: A string is novel if it costs at least so much of what random strings of its characters' classes cost:
#: one of mixed classes, and one that has the shape of words, which the dictionaries may not all know.
NOVELTY, NOVELTY_OF_WORDS = 0.7, 0.9
#: Words in one case or in camel case, and the marks that join them to identifiers.
_WORDLIKE, _MARKS = re.compile(r"[A-Z]*|[a-z]*(?:[A-Z][a-z]{2,})*"), re.compile(r"[+/_=-]+")
#: Random strings that a candidate is compared with, fewer for long ones.
DRAWS = 8
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")


class Novelty:
    """Marginal compressed size of strings behind their surroundings, under two dictionaries.

    One holds identifiers and phrases as they stand, the other is trained on words joined in the
    ways of identifiers. What words are made of costs little, under one or the other; a random
    string costs as much as any other of its kind.
    """

    def __init__(self) -> None:
        draw, words = random.Random(7), VOCABULARY.split()
        samples = [draw.choice(_STYLES)([draw.choice(words) for _ in range(draw.randint(2, 4))]).encode() for _ in range(6000)]
        self.lead = VOCABULARY.encode()
        both = zstandard.train_dictionary(16384, samples), zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packs = [zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in both]

    def bytes_for(self, pack: Callable[[bytes], bytes], context: bytes, candidate: str) -> int:
        """Compressed bytes that the candidate adds to its context."""
        return len(pack(context + candidate.encode())) - len(pack(context))

    def is_novel(self, before: str, candidate: str, after: str = "") -> bool:
        """Whether the candidate costs what random strings do, by whichever dictionary knows it best.

        Ahead of the candidate stand common words and its surroundings, where it may be repeated and is left out.
        So there always is text enough for the compressor to tell common letters from rare ones."""
        context = self.lead + f" {after} {before}".replace(candidate, " ").encode("utf-8", "surrogatepass")
        letters = "".join(c for c in _CLASSES if set(c) & set(candidate)) or _CLASSES[-1]
        n = len(candidate)
        draw = random.Random(f"{letters}{n}")
        least = NOVELTY_OF_WORDS if all(_WORDLIKE.fullmatch(w) for w in _MARKS.split(candidate)) else NOVELTY
        others = ["".join(draw.choices(letters, k=n)) for _ in range(max(1, min(DRAWS, 16384 // n)))]
        for pack in self.packs:
            expected = sum(self.bytes_for(pack, context, x) for x in others) / len(others)
            if self.bytes_for(pack, context, candidate) < least * expected:
                return False
        return True


_novelty: list[Novelty] = []


def novelty() -> Novelty:
    """One for each Python worker, made when the first candidate is met."""
    if not _novelty:
        _novelty.append(Novelty())
    return _novelty[0]


def base_spans(text: str, lowered: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping for each kind."""
    out = []
    if any(w in lowered for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, lowered: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of 16 characters or more of which secrets are made, close behind a sensitive
    word and outside of what is taken."""
    near = sorted(m.end() for w in CONTEXT_WORDS if w in lowered for m in re.finditer(re.escape(w), lowered))
    done = 0
    for end in near:
        # a candidate starts in reach, and is taken to the end of its run
        while start := _CANDIDATE.search(text, max(end, done), min(len(text), end + REACH + 16)):
            m = _CANDIDATE.match(text, start.start())
            done = m.end()
            if not any(s < m.end() and m.start() < e for s, _, e in taken):
                yield m.span()


def novel_spans(text: str, lowered: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that are incompressible behind identifiers and surroundings."""
    found = candidates(text, lowered, taken)
    return [(s, 3, e) for s, e in found if novelty().is_novel(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND])]


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a whole text as (start, kind, end), by start and kind; code points, end exclusive."""
    text = text or ""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is two: keep positions
        lowered = text.translate(_LOWER)
    base = base_spans(text, lowered)
    return sorted(base + novel_spans(text, lowered, base))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (array of kind, start, end, text) for each row of docs.

    found is sorted by start, then by kind in the order of KINDS. Null and empty texts find
    nothing. Rows pass one by one: repeated rows repeat, an empty table stays empty, other
    columns are not read; texts of any length are searched to their end.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                found.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in find_secrets(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint,text:string>>")


def with_digests(secrets: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of what scan_secrets() returns,
    row by row: a text without spans has zeros, the digest of nothing and an empty string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "novel")
    return secrets.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("novel").alias("n_novel"),
    )
