"""Redaction, screening, data-subject requests and retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as tx

# The recognizers and their tags, in the order in which they apply. Group 1, if any, stays.
PII = (
    ("[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("[CARD_NUMBER]", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    ("[ID_NUMBER]", r"(?<!\d)\d{12}(?!\d)"),
    ("[ID_NUMBER]", r"(?iu)((?:cmnd|cmt|chứng minh(?: nhân dân| thư)?)\D{0,15})\d{9}(?!\d)"),
    ("[TAX_CODE]", r"(?iu)((?:mst|mã số thuế)\D{0,10})\d{10}(?:-\d{3})?(?!\d)"),
    ("[BANK_ACCOUNT]", r"(?iu)((?:stk|số tài khoản|tài khoản(?: ngân hàng)?)\D{0,15})\d{6,16}(?!\d)"),
    ("[PASSPORT]", r"(?iuU)(\b(?:hộ chiếu|ho chieu|passport|số hc)\W{0,15}(?:số\W{0,5})?)[a-z]\d{7,8}(?![a-z\d])"),
    (
        "[BIRTH_DATE]",
        r"(?iuU)(\b(?:ngày sinh|sinh ngày|ngay sinh|sinh ngay|date of birth|dob|born on)\W{0,10})\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}(?!\d)",
    ),
    ("[PHONE]", r"(?<![\d+])(?:\+84|84|0)(?:[\s.-]?\d){8,10}(?!\d)"),
)
TAGS = tuple(dict.fromkeys(tag for tag, _ in PII))

# What marks an injection, a wish for a person, a greeting and thanks in folded text.
INJECTION = (
    r"ignore (all |any |the )?(previous|prior|above|earlier) (instructions|prompts|rules|messages)",
    r"disregard (all |the )?(previous|prior|above|system) (instructions|prompt|rules)",
    r"(reveal|show|print|repeat|output) (me )?((your|the) (system|initial|hidden|original) (prompt|instructions)|your (prompt|instructions))",
    r"(what are|tell me) your (system |initial |hidden )?(prompt|instructions|rules)",
    r"forget (all |any |the |your )?(previous |prior |above |earlier )?(instructions|prompts|rules)",
    r"(act as|pretend (you are|to be)|you are now) .{0,40}(unrestricted|unfiltered|no (rules|limits|restrictions|filters)|without (any )?(rules|limits|restrictions|filters))",
    r"\byou are (now )?dan\b",
    r"\b(developer|dan|god) mode\b",
    r"\bjailbreak",
    r"<\|?(system|im_start|im_end)\|?>",
    r"^\s*(system|assistant)\s*:",
    r"bo qua (tat ca |moi |cac |nhung )?(huong dan|chi dan|chi thi|cau lenh|lenh|quy tac|yeu cau) (truoc|tren|ban dau|he thong|cu)",
    r"quen (het |di |tat ca |moi )?(cac |nhung )?(huong dan|quy tac|chi dan) (truoc|tren|ban dau)",
    r"(tiet lo|hien thi|in ra|cho (toi|minh|tao) xem|nhac lai|lap lai) (lai )?(system prompt|prompt (he thong|goc)|huong dan (he thong|goc|ban dau)|cau lenh he thong)",
    r"(dong vai|gia vo la|hay tro thanh|(tu )?(bay )?gio ban la) .{0,40}(khong (bi |co )?(gioi han|kiem duyet|rang buoc))",
)
HUMAN = (
    r"(gap|noi chuyen (voi)?|ket noi (voi)?|chuyen (cho|sang|toi|den)|lien he (voi)?|goi (cho)?) ?(mot |1 )?(nhan vien|tu van vien|nguoi that|nguoi ho tro|admin|cskh|tong dai vien|can bo)",
    r"\b(talk|speak|chat) (to|with) (a |an )?(human|real person|agent|staff|operator)\b",
    r"\b(live|human) (agent|support)\b",
)
GREETING = r"^(xin chao|chao( ban| bot| em| anh| chi| ad| admin)?|hello|hi|hey|alo|a lo|good (morning|afternoon|evening))[\s!.,?~]*$"
THANKS = r"^(cam on|cam on ban|cam on nhieu|thanks?( you)?|thank you( so much)?|ok cam on|tks|thanks a lot)( ban| nhe| nha| nhieu| a| bot| em)*[\s!.,~]*$"


def redacted(text: Column) -> Column:
    """The text with every recognized item replaced by its tag, rule by rule; null stays null.

    The first rule needs an @ and the others a digit, so texts without them skip the rules.
    """
    (tag, pattern), *others = PII
    out = mailed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, pattern, tag)).otherwise(text)
    for tag, pattern in others:
        if tag == "[CARD_NUMBER]":
            out = _cards_replaced(out, pattern, tag)
        else:
            out = F.regexp_replace(out, pattern, ("$1" if "u)(" in pattern or "U)(" in pattern else "") + tag)
    return F.when(text.rlike(r"\d"), out).otherwise(mailed)


def _cards_replaced(text: Column, pattern: str, tag: str) -> Column:
    """The runs of digits that are card numbers replaced where they stand; what is between runs is not looked at."""
    between, runs = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(between, runs, lambda x, run: F.concat(x, F.when(_is_card(run), tag).otherwise(F.coalesce(run, F.lit("")))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _is_card(run: Column) -> Column:
    digits = F.regexp_replace(run, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def redact_pii(df: DataFrame, column: str) -> DataFrame:
    """df with the column redacted and ``pii``, how many of each tag it now has more; null texts have none."""
    new, old = F.col("__new"), F.col(column)

    def more(tag: str) -> Column:
        """By lengths: a tag's own characters go when it is removed."""
        gone = [F.length(t) - F.length(F.replace(t, F.lit(tag))) for t in (new, old)]
        return ((gone[0] - gone[1]) / len(tag)).cast("int")

    every = F.map_from_arrays(F.array(*[F.lit(t) for t in TAGS]), F.array(*[more(t) for t in TAGS]))
    none = F.create_map().cast("map<string,int>")
    counts = F.when(new != old, F.map_filter(every, lambda _, n: n > 0)).otherwise(none)
    return df.withColumn("__new", redacted(old)).withColumn("pii", counts).withColumn(column, new).drop("__new")


def screen(text: Column) -> Column:
    """block, human_requested, greeting, thanks or allow, in this order."""
    plain = F.trim(F.regexp_replace(tx.fold(tx.normalize_chat(text)), r"\s+", " "))
    return (
        F.when(plain.rlike("|".join(f"(?:{p})" for p in INJECTION)), "block")
        .when(plain.rlike("|".join(f"(?:{p})" for p in HUMAN)), "human_requested")
        .when(plain.rlike(GREETING), "greeting")
        .when(plain.rlike(THANKS), "thanks")
        .otherwise("allow")
    )


def match_topics(df: DataFrame, column: str, topics: Sequence[str]) -> DataFrame:
    """df with ``topic``: the first of the list whose words the text has, without regard to accents and case."""
    tokens = F.concat(F.lit(" "), F.array_join(tx.search_tokens(F.col(column)), " "), F.lit(" "))
    found = F.coalesce(*[F.when(F.contains(F.col("__t"), F.concat(F.lit(" "), tx.normalized_key(F.lit(t)), F.lit(" "))), F.lit(t)) for t in topics])
    return df.withColumn("__t", tokens).withColumn("topic", found).drop("__t")


def redact_secret_keys(json: Column, keys: Sequence[str] = ("password", "token", "secret", "api_key")) -> Column:
    """JSON text with the scalar values of these keys masked, at any depth."""
    names = "|".join(keys)
    return F.regexp_replace(json, rf'(?i)("[^"]*(?:{names})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^\s,{{}}\[\]"]+)', '$1"***"')


def mask_email(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(1)), F.lit("***@"), F.split_part(c, F.lit("@"), F.lit(2)))


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("***"), F.right(c, F.lit(3)))


def mask_last4(c: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - 4, F.lit(0))), F.right(c, F.lit(4)))


def hash_key(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(24))


def subject_conversations(conversations: DataFrame, tickets: DataFrame, user: str | None, visitor: str | None, email: str | None) -> DataFrame:
    """Conversations of a person by user id or visitor id, or with a ticket under their e-mail."""
    own = conversations.where(F.col("user_id").eqNullSafe(F.lit(user)) & F.lit(user is not None) | (F.col("end_user_id") == F.lit(visitor)))
    told = conversations.join(tickets.where(F.col("email") == F.lit(email)), "conv_id", "left_semi")
    return own.unionByName(told).distinct()


def subject_export(subject: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(conv_id, messages) with ratings nested, in order."""
    rated = messages.join(subject.select("conv_id"), "conv_id", "left_semi").join(feedback.select("message_id", "rating"), "message_id", "left")
    return rated.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "rating"))).alias("messages"))


def subject_delete(subject: DataFrame, tickets: DataFrame) -> DataFrame:
    """subject with ``held``: on hold itself or by a ticket on hold, so not to be removed."""
    hold = tickets.where("legal_hold").select("conv_id").distinct().withColumn("__held", F.lit(True))
    return subject.join(hold, "conv_id", "left").withColumn("held", F.col("legal_hold") | F.coalesce("__held", F.lit(False))).drop("__held")


def subjects_tickets(subjects: DataFrame, conversations: DataFrame, tickets: DataFrame) -> DataFrame:
    """(subject_id, ticket_id, conv_id, held) of a batch of subjects (subject_id, user_id, visitor_id, email).

    A ticket is a person's who opened it signed in, whose e-mail it has in any case of letters, or in whose conversation as
    a visitor it was opened. What is null or empty of a person matches nothing. ``held``: it or its conversation is
    on hold.
    """
    own = tickets.join(conversations.select("conv_id", "user_id", F.col("end_user_id").alias("visitor_id"), F.col("legal_hold").alias("__held")), "conv_id", "left")
    own = own.select("ticket_id", "conv_id", "user_id", "visitor_id", F.lower("email").alias("email"), (F.col("legal_hold") | F.coalesce("__held", F.lit(False))).alias("held"))
    keyed = subjects.withColumn("email", F.lower("email"))
    found = [own.join(_known(keyed, c), c).select("subject_id", "ticket_id", "conv_id", "held") for c in ("user_id", "visitor_id", "email")]
    return reduce(DataFrame.unionByName, found).distinct()


def subjects_conversations(subjects: DataFrame, conversations: DataFrame, theirs: DataFrame) -> DataFrame:
    """(subject_id, conv_id, held): theirs as user or visitor, and those behind their tickets; held by themselves or by a ticket."""
    own = conversations.select("conv_id", "user_id", F.col("end_user_id").alias("visitor_id"), "legal_hold")
    found = [own.join(_known(subjects, c), c).select("subject_id", "conv_id", "legal_hold") for c in ("user_id", "visitor_id")]
    found.append(theirs.select("subject_id", "conv_id").distinct().join(own, "conv_id").select("subject_id", "conv_id", "legal_hold"))
    holds = theirs.where("held").select("subject_id", "conv_id", F.lit(True).alias("__held")).distinct()
    every = reduce(DataFrame.unionByName, found).distinct().join(holds, ["subject_id", "conv_id"], "left")
    return every.select("subject_id", "conv_id", (F.col("legal_hold") | F.coalesce("__held", F.lit(False))).alias("held"))


def _known(subjects: DataFrame, column: str) -> DataFrame:
    return subjects.where(F.col(column).isNotNull() & (F.col(column) != "")).select("subject_id", column)


def subjects_export(subjects: DataFrame, conversations: DataFrame, tickets: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(subject_id, conv_id, messages, tickets): each conversation with its messages and ratings, and the person's tickets in it."""
    theirs = subjects_tickets(subjects, conversations, tickets)
    own = subjects_conversations(subjects, conversations, theirs)
    rated = messages.join(feedback.select("message_id", "rating"), "message_id", "left")
    told = rated.join(own.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id")
    nested = told.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "rating"))).alias("messages"))
    of_tickets = theirs.join(tickets.select("ticket_id", "status", "reason", "created_at"), "ticket_id").groupBy("subject_id", "conv_id")
    listed = of_tickets.agg(F.array_sort(F.collect_list(F.struct("ticket_id", "status", "reason", "created_at"))).alias("tickets"))
    return own.join(nested, "conv_id", "left").join(listed, ["subject_id", "conv_id"], "left").select("subject_id", "conv_id", "messages", "tickets")


def subjects_delete(subjects: DataFrame, conversations: DataFrame, tickets: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(subject_id, conversations, messages, ratings, tickets, held_conversations, held_tickets): what goes, and what a hold keeps.

    A conversation that is kept keeps its messages and ratings; a ticket that is kept keeps its conversation.
    """
    theirs = subjects_tickets(subjects, conversations, tickets)
    own = subjects_conversations(subjects, conversations, theirs)
    gone = own.where("NOT held").select("subject_id", "conv_id")
    counts = {
        "conversations": gone, "messages": gone.join(messages.select("conv_id"), "conv_id"), "ratings": gone.join(feedback.select("conv_id"), "conv_id"),
        "tickets": theirs.where("NOT held"), "held_conversations": own.where("held"), "held_tickets": theirs.where("held"),
    }
    rows = reduce(DataFrame.unionByName, [df.groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in counts.items()])
    summed = rows.groupBy("subject_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in counts])
    return subjects.select("subject_id").join(summed, "subject_id", "left").fillna(0, list(counts))


def retention_purge(conversations: DataFrame, tickets: DataFrame, cutoff: Column) -> DataFrame:
    """Conversations that go: idle since the cutoff, not on hold, and without an open or held ticket."""
    keeps = tickets.where(F.col("status").isin("open", "assigned") | F.col("legal_hold"))
    return conversations.where((F.col("last_activity") < cutoff) & ~F.col("legal_hold")).join(keeps, "conv_id", "left_anti")


def purge_dependents(rows: DataFrame, purged: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows that stay: those of no purged conversation; rows without one stay."""
    return rows.join(purged.select(key), key, "left_anti")


def audit_survivors(audit: DataFrame, days: int, now: Column, floor: int = 365) -> DataFrame:
    """Audit rows younger than the policy, which is never under a year."""
    return audit.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(max(days, floor))))
