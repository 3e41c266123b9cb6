"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence, each a likelihood or prior over the same languages, are added as logarithms:
- text: naive Bayes over hashed character trigrams and words of the visible text, tempered to its effective length;
- the markup's declared language, by how often each declaration goes with each language over all pages;
- the address suffix (country-code domain, or a language code as first path part), likewise;
- the host's prior: language shares of the host, smoothed towards those of its registered domain, then all pages.

The tables behind the last three come from grouped aggregation over all pages, of posteriors from text alone; a page's
own share is left out of its host's counts. The text model is fitted on at most `train_rows` labelled documents (first
by a hash of doc_id), a documented bound; everything else covers every page.

Scale: pages are parsed once, in one forward pass over each, so in time linear in its length, however long or broken;
a host that holds a third of all pages is pre-aggregated by task, and its small row is joined back (skew-join splits
the pages). Declarations and suffixes are two or three letters of a to z, so their tables have at most 18,954 and 1,352
rows: those are broadcast. One row of sums for each reaches the driver.

Defined results: null or empty markup and addresses give no evidence, so that what remains decides; with none, the
prior over all pages. Repeated rows get results of their own, and so do rows with a null page_id. Other input columns
are ignored. An empty table gives an empty result; without labelled documents every page's language is null.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, map_texts, written

SLOTS = 1 << 13
HIDDEN = ("script", "style", "noscript", "template")
NAME = re.compile(r"/?[A-Za-z]+")
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.IGNORECASE)
CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
CODE = re.compile(r"[A-Za-z]{2}(?:[-_][A-Za-z]{2})?$")
COUNTRY = re.compile(r"[a-z]{2}")
# Names that registries of country-code domains commonly sell names under, as in example.co.uk.
SECOND_LEVEL = "ac asn asso biz co com ed edu firm gen go gob gouv gov govt gv id inf info int lg ltd me med mil mus ne net nhs nic nom or org plc police pro res sch tm web".split()
MOST_GRAMS = 200  # evidence of a text counts at most as if it had so many independent grams


def read(html: str | None) -> tuple[str, str | None]:
    """(visible text, declared language).

    Tags end at the next `>`; one without is text. Comments and hidden elements without an end hide all that follows.
    """
    html = html or ""
    low = html.lower() if html.isascii() else html.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # offsets stay
    out, declared, at, size = [], None, 0, len(html)
    while at < size:
        tag = html.find("<", at)
        if tag < 0:
            out.append(html[at:])
            break
        out.append(html[at:tag])
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            at = end + 3 if end >= 0 else size
            continue
        name = NAME.match(low, tag + 1)
        if not name and not html.startswith(("<!", "<?"), tag):
            out.append("<")
            at = tag + 1
            continue
        end = html.find(">", tag)
        if end < 0:
            out.append(html[tag:])
            break
        out.append(" ")
        at = end + 1
        name = name[0] if name else ""
        if declared is None and name == "html" and (m := LANG.search(html, tag, end)):
            declared = m[1].lower()
        elif declared is None and name == "meta" and low.find("content-language", tag, end) >= 0 and (m := CONTENT.search(html, tag, end)):
            declared = m[1].lower()
        elif name in HIDDEN:
            close = low.find(f"</{name}", at)
            at = close if close >= 0 else size
    return markup.unescape("".join(out)), declared


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, registered domain, suffix): suffix is a language code in the path, else a country-code domain."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".").removeprefix("www.") or None
    except ValueError:
        return None, None, None
    if not host:
        return None, None, None
    labels = host.split(".")
    first = parts.path.split("/")[1] if parts.path.count("/") else ""
    country = COUNTRY.fullmatch(labels[-1])
    suffix = f"/{first[:2].lower()}" if CODE.match(first) else f".{labels[-1]}" if country else None
    return host, ".".join(labels[-3:] if country and labels[-2:-1] and labels[-2] in SECOND_LEVEL else labels[-2:]), suffix


def grams(text: str) -> np.ndarray:
    """Slot counts of words and character trigrams."""
    out = np.zeros(SLOTS, np.float32)
    seen: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        seen[w] = seen.get(w, 0) + 1
    for w, n in seen.items():
        out[zlib.crc32(f"={w}".encode()) % SLOTS] += n
        padded = f" {w} "
        for i in range(len(padded) - 2):
            out[zlib.crc32(padded[i : i + 3].encode()) % SLOTS] += n
    return out


def train(docs: DataFrame, train_rows: int = 4_000) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each slot) from docs(doc_id, text, lang)."""
    some = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    ids = F.broadcast(written(some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "training"))  # train_rows rows at most
    some = some.join(ids, "doc_id", "left_semi").select("lang", "text").limit(train_rows)

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + grams(text)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(float).tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "counts"])

    # one row for each language and task of a bounded sample
    got = some.mapInArrow(count, "lang string, counts array<double>").toArrow().to_pylist()
    langs = sorted({r["lang"] for r in got})
    table = np.full((len(langs), SLOTS), 0.5)
    for r in got:
        table[langs.index(r["lang"])] += r["counts"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def identify(pages: DataFrame, docs: DataFrame, train_rows: int = 4_000, pull: float = 5.0) -> DataFrame:
    """pages(page_id, url, html) to page_id, host, declared, suffix, text_lang, lang and confidence.

    pull: how many pages a prior one level up counts for.
    """
    langs, table = train(docs, train_rows)
    k = len(langs)
    pages = pages.select("page_id", "url", "html")

    def derive():
        def run(texts):
            rows, said = [], []
            for t in texts:
                text, code = read(t)
                g = grams(text)
                n = g.sum()
                rows.append((table @ g * min(1.0, MOST_GRAMS / n)).tolist() if n else [0.0] * k)
                said.append(code)
            return {"text_ll": rows, "declared": said}

        return run

    def place():
        return lambda urls: dict(zip(("host", "domain", "suffix"), map(list, zip(*(address(u) for u in urls), strict=True)), strict=True)) if urls else {"host": [], "domain": [], "suffix": []}

    parsed = map_texts(pages, derive, "text_ll array<double>, declared string", keep=("page_id", "url"), text="html")
    parsed = written(map_texts(parsed, place, "host string, domain string, suffix string", keep=("page_id", "text_ll", "declared"), text="url"), "pages")
    if not k:
        none = F.lit(None).cast("string")
        return parsed.select("page_id", "host", "declared", "suffix", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))

    def soft(ll):
        """Probabilities from an array column of log values."""
        top = let(ll, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
        return let(top, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))

    each = parsed.withColumn("p", soft(F.col("text_ll")))
    shares = [F.sum(F.element_at("p", i + 1)).alias(f"s{i}") for i in range(k)]
    sums = lambda by: each.where(F.col(by).isNotNull()).groupBy(by).agg(*shares)
    total = each.agg(*shares).first()
    prior = (np.array([total[i] or 0.0 for i in range(k)]) + 1) / (sum(x or 0.0 for x in total) + k)

    def odds(by: str) -> DataFrame:
        """(code, like): log P(code | language), up to a constant; a code seen once is split by the prior."""
        own = sums(by)
        whole = own.agg(*(F.sum(f"s{i}") for i in range(k))).first()
        like = [F.log((F.col(f"s{i}") + float(prior[i])) / ((whole[i] or 0.0) + 1)) for i in range(k)]
        return F.broadcast(own.select(F.col(by).alias(f"{by}_code"), F.array(*like).alias(f"{by}_like")))  # bounded: see above

    domains = sums("domain").withColumnsRenamed({f"s{i}": f"d{i}" for i in range(k)})
    hosts = each.where("host is not null").groupBy("host", "domain").agg(*shares).join(domains, "domain")
    dsum = sum(F.col(f"d{i}") for i in range(k))
    hosts = hosts.select("host", *(f"s{i}" for i in range(k)), *(((F.col(f"d{i}") + pull * float(prior[i])) / (dsum + pull)).alias(f"up{i}") for i in range(k)))
    full = each.join(hosts, "host", "left")
    own = [F.greatest(F.coalesce(F.col(f"s{i}"), F.element_at("p", i + 1)) - F.element_at("p", i + 1), F.lit(0.0)) for i in range(k)]
    others = sum(own)
    host_prior = F.array(*(F.log((own[i] + pull * F.coalesce(f"up{i}", F.lit(float(prior[i])))) / (others + pull)) for i in range(k)))
    parts = [F.col("text_ll"), host_prior]
    for by in ("declared", "suffix"):
        full = full.join(odds(by), F.col(by) == F.col(f"{by}_code"), "left")
        parts.append(F.coalesce(f"{by}_like", F.array(*[F.lit(0.0)] * k)))
    fused = parts[0]
    for x in parts[1:]:
        fused = F.zip_with(fused, x, lambda a, b: a + b)
    names = F.array(*map(F.lit, langs))
    full = full.select("page_id", "host", "declared", "suffix", "text_ll", soft(fused).alias("post"))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return full.select("page_id", "host", "declared", "suffix", best("text_ll").alias("text_lang"), best("post").alias("lang"), F.array_max("post").alias("confidence"))
