"""Facts in letters' texts by patterns: references, dates, parties, actions, types, topics, amounts; support of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled and bare reference formats, in order.
REF_PATTERNS = [
    r"(?:Ref|Reference|Our\s*Ref|Your\s*Ref)\s*[:.]?\s*([A-Za-z0-9\-_/]+(?:[-/][A-Za-z0-9]+)*)",
    r"(?:Doc(?:ument)?\s*(?:No|Number|#))\s*[:.]?\s*([A-Za-z0-9\-_/]+)",
    r"(?:Letter\s*(?:No|Number|#))\s*[:.]?\s*([A-Za-z0-9\-_/]+)",
    r"(?:Contract\s*(?:No|Number|#))\s*[:.]?\s*([A-Za-z0-9\-_/]+)",
    r"(?:Notice\s*(?:No|Number|#))\s*[:.]?\s*([A-Za-z0-9\-_/]+)",
    r"\b([A-Z]{2,5}[-/]\d{3,}(?:[-/]\d+)*)\b",
    r"\b([A-Z]{2,5}/[A-Z]{2,5}/\d{3,})\b",
]
# Words of each action.
ACTIONS = {
    "submit": ["submit", "submission", "submitted", "submitting"],
    "respond": ["respond", "response", "reply", "answer", "replying"],
    "approve": ["approve", "approval", "approved", "approving"],
    "reject": ["reject", "rejection", "rejected", "rejecting"],
    "delay": ["delay", "delayed", "postpone", "postponement", "extension of time"],
    "claim": ["claim", "claims", "claiming", "entitlement"],
    "notify": ["notify", "notification", "notice", "hereby notify", "notifying"],
    "request": ["request", "requesting", "requested", "kindly request"],
    "confirm": ["confirm", "confirmation", "confirmed", "confirming"],
    "complete": ["complete", "completed", "completion", "substantial completion"],
    "terminate": ["terminate", "termination", "terminated"],
    "suspend": ["suspend", "suspension", "suspended"],
    "handover": ["handover", "hand over", "handing over", "takeover"],
    "inspect": ["inspect", "inspection", "inspected", "site inspection"],
    "instruct": ["instruct", "instruction", "instructed", "hereby instruct"],
    "certify": ["certify", "certificate", "certification", "certified"],
    "warranty": ["warranty", "defects liability", "retention", "defect notification"],
    "payment": ["payment", "interim payment", "final payment", "pay", "invoice"],
    "variation": ["variation", "variation order", "change order", "scope change"],
    "disclaimer": ["responsibility", "liable", "liability", "disclaim", "without prejudice"],
    "progress": ["progress", "progress report", "daily progress", "weekly progress"],
}
# Words that point to a document's type.
DOC_TYPES = {
    "letter": ["dear", "sincerely", "regards", "kind regards", "best regards", "yours faithfully", "yours sincerely"],
    "notice": ["notice", "notification", "hereby notify", "formal notice", "notice of delay", "notice of claim"],
    "report": ["report", "summary", "findings", "daily progress report", "weekly report", "monthly report", "inspection report"],
    "minutes": ["minutes", "meeting", "attendees", "minutes of meeting", "action items", "agenda"],
    "contract": ["contract", "agreement", "terms and conditions", "conditions of contract", "general conditions", "particular conditions"],
    "invoice": ["invoice", "amount due", "payment", "bill", "tax invoice", "interim payment certificate"],
    "transmittal": ["transmittal", "transmitted", "enclosed", "herewith", "please find attached", "for your review"],
    "email": ["from:", "sent:", "to:", "cc:", "subject:", "forwarded message"],
    "dpr": ["daily progress report", "dpr", "manpower", "weather condition", "equipment on site", "work description"],
}
# Terms of each coverage facet.
FACETS = {
    "contractual_framework": ("contract", "agreement", "obligation", "clause", "scope"),
    "programme_baseline": ("programme", "schedule", "baseline", "milestone", "completion"),
    "design_access_interfaces": ("design", "access", "utility", "interface", "consent"),
    "instructions_notices_change": ("instruction", "notice", "change", "variation", "departure"),
    "party_positions": ("asserted", "contended", "responded", "position", "disputed"),
    "delay_prolongation": ("delay", "stoppage", "prolongation", "late", "disruption"),
    "dispute_resolution": ("dispute", "adjudication", "mediation", "settlement", "resolution"),
    "contradictions_missing": ("inconsistent", "contradict", "missing", "unavailable", "not recorded"),
}
# Patterns of names of persons and companies; the group is the name.
PERSONS = [
    r"(?:Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Eng\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"(?:Dear|Attention|Attn)\s+(?:Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Eng\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"(?:Kind\s+Regards|Best\s+Regards|Sincerely)\s*[,.]?\s*\n+\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
]
COMPANIES = [
    r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:LLC|Ltd|Inc|Corp|Co\.|Group|Engineering|Construction|Properties|Contracting))\b",
    r"\b((?:Al\s+)?[A-Z][a-z]+(?:\s+(?:&|and)\s+[A-Z][a-z]+)*\s+(?:LLC|Ltd|Inc|Corp|Co\.))\b",
]
AMOUNT = r"(?:AED|USD|EUR|GBP|\$)\s?\d[\d,]*(?:\.\d+)?"
DURATION = r"(?i)\b\d+\s+(?:calendar\s+|working\s+)?(?:days?|weeks?|months?|years?)\b"
DEADLINE = r"(?i)\b(?:within|by|before|no later than)\s+(?:\d+\s+(?:calendar\s+|working\s+)?(?:days?|weeks?)|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


# Patterns of the claims of each type; the group is what is claimed.
CLAIMS = {
    "delay": [
        r"(?:delay|delayed|postponement|behind\s+schedule|slippage)\s+(?:of|in|to)\s+(.{10,100})",
        r"(?:extension\s+of\s+time|EOT)\s+(?:for|due\s+to|of)\s+(.{10,100})",
        r"(?:critical\s+path|programme|schedule)\s+(?:has\s+been|is|was)\s+(?:delayed|impacted|affected)\s+(.{10,100})",
    ],
    "cost": [
        r"(?:additional\s+cost|extra\s+cost|cost\s+overrun|price\s+increase)\s+(?:of|for)\s+(.{10,100})",
        r"(?:claim|entitlement)\s+(?:for|of)\s+(.{10,100})",
        r"(?:invoice|payment|amount\s+due)\s+(?:of|for)\s+(.{10,100})",
    ],
    "completion": [
        r"(?:substantial\s+completion|practical\s+completion|handover)\s+(?:of|for|date)\s*(?:is|was|shall\s+be)?\s*(.{10,100})",
        r"(?:completion\s+date|target\s+date|milestone)\s+(?:is|was|shall\s+be)\s+(.{10,100})",
    ],
    "responsibility": [
        r"(?:responsibility|liable|liability|obligation)\s+(?:of|for|to)\s+(.{10,100})",
        r"(?:without\s+prejudice|disclaim|not\s+responsible)\s+(.{10,100})",
        r"(?:hereby\s+notify|formally\s+notify)\s+(.{10,100})",
    ],
    "instruction": [
        r"(?:hereby\s+instruct|please\s+(?:ensure|arrange|proceed|provide))\s+(.{10,100})",
        r"(?:you\s+are\s+(?:required|instructed|directed)\s+to)\s+(.{10,100})",
    ],
    "request": [
        r"(?:kindly\s+(?:provide|submit|arrange|confirm))\s+(.{10,100})",
        r"(?:request\s+(?:for|to|that))\s+(.{10,100})",
        r"(?:please\s+(?:provide|submit|arrange|confirm|note))\s+(.{10,100})",
    ],
}
# Words that carry no topic, and how many terms and how long.
STOP_WORDS = (
    "the", "and", "for", "what", "which", "show", "list", "how", "many", "does",
    "are", "was", "were", "from", "with", "this", "that", "about", "give", "tell",
    "ne", "nedir", "kaç", "hangi", "için", "ve", "bir", "göster",
)
TERMS, TERM_LEAST = 5, 4
# Characters of a source's snippet and highlight, sentences of the latter.
SNIPPET, HIGHLIGHT, SENTENCES = 500, 300, 3


def labelled(text: Column, labels: str) -> Column:
    """The rest of the first line that begins with one of the labels and a colon; null where none does."""
    got = F.trim(F.regexp_extract(text, rf"(?im)^\s*(?:{labels})\s*:\s*(.+?)\s*$", 1))
    return F.when(got != "", got)


def references(text: Column, most: int = 10) -> Column:
    """Distinct references of at least three characters with a digit, in order of pattern and place, the first few."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REF_PATTERNS))
    return F.slice(F.array_distinct(F.filter(found, lambda r: (F.length(r) >= 3) & r.rlike("[0-9]"))), 1, most)


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def actions(text: Column) -> Column:
    """Names of the actions of which a word occurs, in the fixed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(_any(low, words), F.lit(a)) for a, words in ACTIONS.items())))


def doc_type(text: Column) -> Column:
    """The type with the most indicators in the text, the first of equals; ``other`` without any."""
    low = F.lower(text)
    counts = [(t, sum((low.contains(w).cast("int") for w in words), F.lit(0))) for t, words in DOC_TYPES.items()]
    best, out = F.greatest(*(c for _, c in counts)), F.lit("other")
    for t, c in reversed(counts):
        out = F.when((c == best) & (best > 0), F.lit(t)).otherwise(out)
    return out


#: Patterns of each kind of entity, the group that is its value, and the fewest characters of that.
KINDS = {"person": (PERSONS, 1, 4), "company": (COMPANIES, 1, 6), "amount": ([AMOUNT], 0, 1), "duration": ([DURATION], 0, 1), "deadline": ([DEADLINE], 0, 1), "email": ([EMAIL], 0, 1)}


def entities(docs: DataFrame) -> DataFrame:
    """Persons, companies, amounts, durations, deadlines and addresses of mail, once a document, kind and value in lower case."""
    def named(kind: str, pattern: str, group: int, least: int) -> Column:
        values = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))

    found = [named(kind, p, group, least) for kind, (patterns, group, least) in KINDS.items() for p in patterns]
    return docs.filter("text is not null").select("doc_id", F.explode(F.concat(*found)).alias("e")).select("doc_id", "e.*").distinct()


def notices(docs: DataFrame) -> DataFrame:
    """One record a letter: parties, subject, references, type, actions, deadlines, contract, carbon copies."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        labelled(text, "From|Sender|Sent by|Issued by|Prepared by").alias("sender"),
        labelled(text, "To|Recipient|Attention|Attn").alias("recipient"),
        labelled(text, "Subject|Subj|Re|Regarding").alias("subject"),
        labelled(text, "CC|Copy to|Copies to|Distribution").alias("cc"),
        labelled(text, "Project|Project Name|Project Title").alias("project"),
        F.nullif(F.regexp_extract(text, r"(?:Contract|Agreement)\s*(?:No|Number|Ref|#)\s*[:.]?\s*([A-Za-z0-9\-_/]+)", 1), F.lit("")).alias("contract_ref"),
        references(text).alias("refs"),
        doc_type(text).alias("doc_type"),
        actions(text).alias("actions"),
        F.slice(F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(0)), 1, 5).alias("deadlines"),
    )


def html_text(html: Column) -> Column:
    """Text of a page: without styles, scripts and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<style.*?</style>", " "), r"(?is)<script.*?</script>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def ocr_clean(text: Column) -> Column:
    """Words broken over lines joined, ligatures spelled out, blanks collapsed."""
    out = F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def facet_counts(text: Column) -> dict[str, Column]:
    """Occurrences of each facet's terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {f: F.regexp_count(low, F.lit("|".join(terms))) for f, terms in FACETS.items()}


def supported(claim: Column, source: Column, least: float = 0.12) -> Column:
    """Whether every number and quotation of a claim stands in the source, and enough of its words do."""
    verbatim = F.concat(F.regexp_extract_all(claim, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), F.regexp_extract_all(claim, F.lit('"([^"]+)"'), F.lit(1)))
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    share = F.size(F.array_intersect(words(claim), words(source))) / F.greatest(F.size(words(claim)), F.lit(1))
    return F.forall(verbatim, lambda v: source.contains(v)) & (share >= least)


def text_quality_needs_ocr(chars: Column, letters: Column, image_share: Column, few: int = 100) -> Column:
    """Whether a page should be read again as an image: hardly any text, few letters in it, or mostly image."""
    return (chars < 30) | (letters / F.greatest(chars, F.lit(1)) < 0.2) | ((image_share > 0.7) & (chars < few))


def claims(docs: DataFrame) -> DataFrame:
    """Claims of ``docs(doc_id, text)``: for each pattern the first thing claimed that is longer than ten characters.

    White space in it is collapsed and marks at its end are cut off;
    ``snippet`` is the place in the text, fifty characters to either side of
    what is claimed. Null texts have none.

    Returns ``doc_id, claim_type, pattern, description, snippet``.
    """
    text = F.coalesce("text", F.lit(""))

    def first(kind: str, at: int, pattern: str) -> Column:
        raw = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))
        clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "[.,;]+$", "")
        one = F.try_element_at(F.filter(raw, lambda x: F.length(clean(x)) > 10), F.lit(1))
        begin = F.greatest(F.lit(1), F.call_function("instr", text, one) - 50)
        snippet = F.left(F.substring(text, begin, F.length(one) + 100), F.lit(300))
        return F.when(one.isNotNull(), F.struct(F.lit(kind).alias("claim_type"), F.lit(at).alias("pattern"), F.left(clean(one), F.lit(200)).alias("description"), snippet.alias("snippet")))

    found = F.array_compact(F.array(*(first(k, i, p) for k, ps in CLAIMS.items() for i, p in enumerate(ps))))
    return docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def salient_terms(question: Column, most: int = TERMS) -> Column:
    """The first few distinct words of a question of at least TERM_LEAST letters or digits that are no stop words."""
    words = F.split(F.lower(F.coalesce(question, F.lit(""))), "[^a-zA-Z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= TERM_LEAST) & ~w.isin(*STOP_WORDS))), 1, most)


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """A text's beginning, with dots where it goes on."""
    bare = _stripped(text)
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most)), F.lit("..."))).otherwise(bare)


def highlight(text: Column) -> Column:
    """A text's first sentences on one line, with dots where there are more."""
    sentences = F.split(F.replace(_stripped(text), F.lit("\n"), F.lit(" ")), r"\. ", -1)
    shown = F.array_join(F.slice(sentences, 1, SENTENCES), ". ")
    return F.left(F.concat(shown, F.when(F.size(sentences) > SENTENCES, "...").otherwise("")), F.lit(HIGHLIGHT))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
