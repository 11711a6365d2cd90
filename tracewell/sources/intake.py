"""Fields of records and parts of documents: header types, alias tables, headed chunks, sentence windows, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text

#: Entity type of a header, and of parts of headers that no table names, in order. Fixed values.
HEADERS = {
    "person": ("name", "full_name", "person_name", "suspect_name", "accused", "accused_name", "contact_person", "subject_name", "victim_name", "witness_name", "applicant_name", "name_of_person"),
    "phone": ("phone", "phone_number", "phone_no", "mobile", "mobile_number", "mobile_no", "contact", "contact_no", "telephone", "caller", "caller_number", "callee", "receiver_number"),
    "vehicle": ("vehicle_no", "vehicle_number", "registration_no", "reg_no", "vehicle_registration", "vehicle", "car_no", "bike_no"),
    "account": ("account_no", "account_number", "bank_account", "account_id"),
    "document": ("aadhaar", "aadhaar_no", "aadhaar_number", "pan", "pan_number", "pancard", "passport", "passport_number", "document_no", "document_id", "id_card", "driving_license", "dl_no"),
    "organization": ("organization", "organisation", "org", "company", "employer", "works_for", "institute", "firm", "bank_name"),
    "location": ("location", "address", "city", "place", "visit_place", "location_visited", "area", "district", "state", "destination"),
    "event": ("event", "incident", "event_name", "activity"),
}
HINTS = (
    ("mobile_no", "phone"), ("mobile_number", "phone"), ("vehicle", "vehicle"), ("_reg_no", "vehicle"), ("reg_number", "vehicle"), ("aadhaar", "document"), ("aadhar", "document"),
    ("passport", "document"), ("pancard", "document"), ("employer", "organization"), ("organisation", "organization"), ("company", "organization"), ("address", "location"),
)
#: Headers that hold each part of a transaction, the first that is there counts. Fixed values.
ALIASES = {
    "reference": ("transaction_id", "txn_id", "upi_txn_id", "utr", "reference_no", "ref_no", "transaction_ref"),
    "amount": ("amount", "transaction_amount", "txn_amount", "value", "sum"),
    "currency": ("currency", "currency_code", "ccy"),
    "receiver": ("beneficiary_name", "payee_name", "receiver_name", "beneficiary", "payee"),
    "receiver_phone": ("beneficiary_phone", "receiver_number", "payee_phone"),
    "account": ("account", "account_no", "account_number", "account_id", "bank_account", "upi_id", "vpa"),
    "bank": ("bank_name", "bank", "ifsc_bank"),
    "merchant": ("merchant", "merchant_name", "payee_merchant"),
    "party": ("name", "party_name", "customer_name"),
    "status": ("status", "txn_status", "transaction_status", "payment_status"),
    "time": ("date", "time", "occurred_at", "timestamp", "txn_date", "value_date", "posted_at"),
}
#: Longest chunk of a document. Fixed value.
CHUNK = 1800


def header_type(name: Column) -> Column:
    """Entity type of a header: by its normalised name, or else by the first hint that it contains."""
    h = text.header(name)
    exact = {x: kind for kind, names in HEADERS.items() for x in names}
    table = F.create_map(*[F.lit(v) for kv in exact.items() for v in kv])
    out = F.when(F.element_at(table, h).isNotNull(), F.element_at(table, h))
    for part, kind in HINTS:
        out = out.when(F.contains(h, F.lit(part)), kind)
    return out


def transaction_parts(raw: Column) -> list[Column]:
    """A column for each of ALIASES from a map of fields: the first alias whose value is not blank.

    The names are normalised once a row: the parts are made of a lambda's variable, and the columns are fields of one common struct.
    """
    by_name = F.map_from_entries(F.transform(F.array_sort(F.map_entries(raw)), lambda e: F.struct(text.header(e["key"]), F.nullif(F.trim(e["value"]), F.lit("")))))
    parts = F.transform(F.array(by_name), lambda m: F.struct(*[F.coalesce(*[F.element_at(m, F.lit(a)) for a in names]).alias(part) for part, names in ALIASES.items()]))
    return [F.get(parts, F.lit(0))[part].alias(part) for part in ALIASES]


def record_text(raw: Column) -> Column:
    """Values of the fields whose header no table of HEADERS names, in the order of the map."""
    named = [F.lit(x) for names in HEADERS.values() for x in names]
    kept = F.filter(F.map_entries(raw), lambda e: ~F.array_contains(F.array(*named), text.header(e["key"])) & (F.coalesce(F.trim(e["value"]), F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda e: e["value"]), " ")


def headed_chunks(docs: DataFrame, key: str, body: str, most: int = CHUNK) -> DataFrame:
    """key, chunk (from 0), heading, text: a document cut at its headings (lines that start with #).

    Parts without text are left out; a part is added to the chunk before it while both together have under
    half of ``most`` characters, and else starts a chunk of at most ``most``.
    """
    lines = docs.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    up = Window.partitionBy(key).orderBy("n")
    head = F.col("line").startswith("#")
    title = F.substring(F.trim(F.regexp_replace("line", "^[# ]+", "")), 1, 120)
    lines = lines.withColumns({"part": F.sum(F.when(head, 1).otherwise(0)).over(up), "head": F.when(head & (title != ""), title)})
    lines = lines.withColumn("heading", F.coalesce(F.last("head", ignorenulls=True).over(up), F.lit("preamble")))
    parts = lines.where(~head).groupBy(key, "part").agg(F.min("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("t"))
    strip = F.regexp_replace("t", r"^\s+|\s+$", "")
    parts = parts.select(key, "part", "heading", strip.alias("t")).where("t <> ''")
    each = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "heading", "t"))).alias("p"))
    none = F.array().cast("array<struct<heading:string,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        small = (F.size(acc) > 0) & (F.coalesce(F.length(last["text"]), F.lit(0)) + F.length(x["t"]) < most // 2)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["text"], F.lit("\n\n"), x["t"]).alias("text"))))
        return F.when(small, joined).otherwise(F.concat(acc, F.array(F.struct(x["heading"].alias("heading"), F.substring(x["t"], 1, most).alias("text")))))

    # element_at of an empty array is never reached: the first part always starts a chunk
    first = F.struct(F.col("p")[0]["heading"].alias("heading"), F.substring(F.col("p")[0]["t"], 1, most).alias("text"))
    chunks = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), F.concat(none, F.array(first)), step)
    return each.select(key, F.posexplode(chunks).alias("chunk", "c")).select(key, "chunk", "c.heading", "c.text")


def sentence_windows(body: Column) -> Column:
    """Array of start and end (0-based, exclusive) of the sentences of a text: cut after . ! ? with white space, and at lines.

    Between two windows one character is counted, however long the gap is, as the records' offsets have it.
    """
    parts = F.split(body, r"(?<=[.!?])\s+|\n+")
    ends = F.aggregate(parts, F.array().cast("array<struct<start:int,end:int,text:string>>"), lambda acc, p: F.concat(acc, F.array(F.struct(F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["end"] + 1).otherwise(0).alias("start"), (F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["end"] + 1).otherwise(0) + F.length(p)).alias("end"), p.alias("text")))))
    return F.filter(ends, lambda w: F.trim(w["text"]) != "")


def encoding(data: Column) -> Column:
    """utf-8, utf-16 by its byte order mark, or latin-1 where the bytes are no UTF-8."""
    mark = F.hex(F.substring(data, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), "utf-16").when(F.is_valid_utf8(data), "utf-8").otherwise("latin-1")


#: What an instruction to a model looks like. Fixed value.
INSTRUCTION = (
    r"(?i)ignore\s+(?:all\s+|previous\s+|prior\s+|the\s+)*(?:instructions?\s*|rules?\s*|prompts?\s*)|set\s+person_names|you\s+(?:must|are|should)\s+(?:respond|reply|output|set|return)"
    r"|reply\s+with\s+only|output\s+(?:only\s+)?(?:one|the)\s+json|as\s+an\s+ai\s+language\s+model|disregard\s+(?:all\s+|previous\s+)?|do\s+not\s+(?:follow|obey)\s+(?:the\s+)?(?:system|previous)"
    r"|पिछले\s+निर्देश|निर्देशों\s+को\s+न\s+मानें?"
)


def in_instruction_context(value: Column, body: Column) -> Column:
    """True if the value occurs in the text, and only in sentences that look like instructions."""
    parts = F.filter(F.split(F.lower(body), r"[\n.!?।]"), lambda p: F.contains(p, F.lower(value)))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(INSTRUCTION)) & (F.length(value) > 0)
