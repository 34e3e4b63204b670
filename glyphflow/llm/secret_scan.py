"""Secrets in texts: three fixed patterns, and strings whose bytes are new to a primed compressor.

Besides the fixed patterns, every run of 16 or more characters of base64 or of identifiers that
follows a sensitive word (within ``CONTEXT`` characters) is a candidate.  Its novelty is what it adds
to a zstandard frame: the compressed size of the surrounding code with the candidate, less that
without, with a dictionary of common identifiers and code loaded before both.  What that means depends
on the place and the length, for the entropy coder may take up to a quarter (of hexadecimal digits: half) of
the bytes of any text.  So it is measured against ``RANDOM`` random strings of the same length, over the
smallest of ``ALPHABETS`` that has all the candidate's characters, in the same place: prose, names put together
from known words, repeated characters and paths cost less than these, keys and tokens cost as much.
Candidates with a digit of at least ``NOVEL`` of the mean cost, or all but ``SLACK`` bytes of it, are
reported: the cost of short random strings varies by some bytes.  The work on a text is linear
in its length: patterns run once over it, and the compressor sees a candidate and a bounded surrounding.

Defined results.  A null text is an empty one and has no spans.  Positions count code points, ends
are exclusive.  Spans of the fixed patterns are leftmost and do not overlap within their kind, and
those that are too short are dropped afterwards.  A candidate that a fixed pattern's span overlaps
is not reported again.  Repeated rows and rows without id are rows like others; other columns
are kept by ``scan``.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256
from random import Random

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Fixed values.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|salt", re.I | re.A)
CONTEXT = 48
AROUND = 512
NOVEL = 0.92
SLACK = 4
RANDOM = 4
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Smaller ones first.
ALPHABETS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/_=-"]
#: What code around a secret is made of.
IDENTIFIERS = """
abstract access account active address admin alias amount api app apple application argument array assert async attribute auth author authorization await backend base batch bearer begin binary block body boolean branch break bucket buffer build builder byte cache call callback catch category cell certificate change channel character charset check child class clear client clone close cloud cluster code collection color column command comment commit common compile component config configuration connect connection console const constant constructor container content context continue control controller convert cookie copy core count create credential cursor customer data database date debug decode default delete deploy description destination detail device dictionary directory disable display document domain double download driver element email enable encode encoding endpoint engine entity entry enum environment error event example exception execute expire export extends extension factory false feature fetch field file filter final finally find first flag float folder format frame framework from function gateway generate get global group guest handle handler hash header height hidden host html http https icon identifier image implementation import include index info init input insert instance int integer interface internal invalid item iterator javascript job join json key keyword kind label lambda language last layer layout length level library license limit line link list listen load local localhost location lock log logger login logout long main manager map mapping master match message metadata method middleware migration mobile mode model modifier module monitor mount name namespace native network next node none normal notification null number object offset open operation option optional order origin output override owner package page parameter parent parse parser partition password path pattern payload permission phone platform plugin point pointer policy pool port position post prefix previous primary print private process processor product production profile program project promise property protected protocol provider proxy public query queue random range read reader record redirect reference refresh region register release remote remove render repository request required reset resource response result return role root route router row rule runtime sample save schedule schema scope script search secret section secure security select sequence serializer server service session set setting setup shared signature size sleep socket sort source specification staging start state statement static status step storage store stream string struct style subject submit success suffix super support switch symbol sync system table tag target task template temporary test text theme thread threshold throw time timeout timestamp title token tool total trace transaction transform transport tree trigger true try type undefined union unique unit update upload upstream url user username utility valid validate value variable vector vendor version view virtual visible void volume wait warning watch web webhook width window worker workflow wrapper write writer yaml year zone
export const config = { apiKey: "", authToken: "", clientSecret: process.env.CLIENT_SECRET }; password = os.environ["PASSWORD"]; Authorization: Bearer
def get_secret_key(self): return self.session_token  public static final String PRIVATE_KEY = "" <input type="password" name="password" autocomplete="current-password">
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx XXXXXXXX ________ -------- ========
"""


class Novelty:
    """Marginal compressed bytes under the dictionary."""

    def __init__(self, level: int = 3) -> None:
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frame = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False)

    def costs(self, before: str, candidates: list[str], after: str) -> list[int]:
        code = (before + after).encode()
        without = len(self.frame.compress(code))
        return [len(self.frame.compress(code + c.encode())) - without for c in candidates]

    def above(self, before: str, candidate: str, after: str, least: float) -> float:
        """Bytes that a candidate costs beyond what it takes, by what random strings like it cost; the same each time."""
        rng, used = Random(candidate), set(candidate)
        alphabet = next((a for a in ALPHABETS if used <= set(a)), ALPHABETS[-1])
        own, *others = self.costs(before, [candidate, *("".join(rng.choices(alphabet, k=len(candidate))) for _ in range(RANDOM))], after)
        mean = sum(others) / RANDOM
        return own - min(least * mean, mean - SLACK)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVEL) -> list[tuple[int, int, int]]:
    out, ends = [], []  # ends: where the taken spans that start no later than each end at the latest
    taken = sorted(taken)
    for _, _, e in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not DIGIT.search(text, a, b) or not SENSITIVE.search(text, max(0, a - CONTEXT), a):
            continue
        before = bisect_left(taken, (b,))
        if before and ends[before - 1] > a:
            continue
        if novelty.above(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND], least) >= 0:
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) with ``n_assign``, ``n_access``, ``n_hex``,
    ``n_novel``, ``base_sha256`` and ``spans``; columns of these names are replaced."""
    names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]

    def find(batches):
        novelty = Novelty()
        for b in batches:
            rows = []
            for text in b[text_col].to_pylist():
                base = base_spans(text or "")
                more = novel_spans(text or "", base, novelty)
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), len(more), sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *columns], names=[*keep, *names])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.mapInArrow(find, ", ".join([*fields, *(f"{c} long" for c in names[:4]), *(f"{c} string" for c in names[4:])]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, keep=["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
