"""Made-up contacts and tickets, derived row by row from a key column.

Every value is arithmetic on the row's own key, so the tables are the same for
any partitioning and any retry, and grow with the key table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word lists of the generated tables.
FIRST_NAMES = ("Ada", "Bruno", "Chen", "Dalia", "Egon", "Farah", "Goran", "Hana", "Ines", "Jonas")
LAST_NAMES = ("Abel", "Berger", "Costa", "Dvorak", "Eriksen", "Fischer", "Galli")
DOMAINS = ("example.com", "example.org", "example.net", "mail.example.co.uk")
CITIES = ("Aarhus", "Bergen", "Cork", "Dresden", "Evora", "Faro", "Graz", "Haifa", "Izmir", "Jena")
STATES = ("active", "churned", "trial", "suspended")
PRIORITIES = ("low", "normal", "high", "urgent")
# Every 17th contact has no e-mail; the score step and range.
NO_EMAIL_EVERY = 17
SCORE_STEP = 37
SCORE_RANGE = 1000


def pick(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def spread(key: Column, step: int, low: int, high: int) -> Column:
    """A number in [low, high] that looks random but follows from the key."""
    return (key * step + step // 3) % (high - low + 1) + low


def _digits(key: Column, step: int, low: int, high: int) -> Column:
    return spread(key, step, low, high).cast("string")


def _email(first: Column, last: Column, key: Column) -> Column:
    first, last = F.lower(first), F.lower(last)
    local = (
        F.when(key % 4 == 0, F.concat(first, F.lit("."), last))
        .when(key % 4 == 1, F.concat(first, F.lit("_"), last))
        .when(key % 4 == 2, F.concat(F.substring(first, 1, 1), last, (key % 100).cast("string")))
        .otherwise(F.concat(first, last))
    )
    return F.concat(local, F.lit("@"), pick(DOMAINS, key))


def _phone(key: Column) -> Column:
    line = _digits(key, 7907, 1000, 9999)
    return (
        F.when(key % 3 == 0, F.concat(F.lit("+1 "), _digits(key, 6101, 200, 989), F.lit("-555-"), line))
        .when(
            key % 3 == 1,
            F.concat(F.lit("0"), _digits(key, 31, 20, 99), F.lit(" "), _digits(key, 4001, 1000, 9999), F.lit(" "), line),
        )
        .otherwise(
            F.concat(F.lit("+84 "), _digits(key, 17, 90, 99), F.lit(" "), _digits(key, 911, 100, 999), F.lit(" "), line)
        )
    )


def _address(key: Column) -> Column:
    return F.concat_ws(
        ".", _digits(key, 53, 10, 220), _digits(key, 101, 0, 255), _digits(key, 151, 0, 255), _digits(key, 211, 1, 254)
    )


def contacts(keys: DataFrame, key: str) -> DataFrame:
    """Nine text columns per key: names, e-mail, phone, city, status, score, address, note."""
    k = F.col(key).cast("bigint")
    first, last = pick(FIRST_NAMES, k), pick(LAST_NAMES, F.floor(k / 7))
    email = F.when(k % NO_EMAIL_EVERY == 0, F.lit("")).otherwise(_email(first, last, k))
    score = F.format_string("%d.%d", F.floor(k * SCORE_STEP % SCORE_RANGE / 10), k * SCORE_STEP % 10)
    known = F.when(email == "", F.lit("unknown")).otherwise(email)
    return keys.select(
        k.cast("string").alias("ID"),
        F.concat_ws(" ", first, last).alias("Name"),
        email.alias("Email"),
        _phone(k).alias("Phone"),
        pick(CITIES, k).alias("City"),
        pick(STATES, k).alias("Status"),
        score.alias("Score"),
        _address(k).alias("Last Seen IP"),
        F.concat(F.lit("contact "), known, F.lit(" re order "), k.cast("string")).alias("Notes"),
    )


def tickets(keys: DataFrame, key: str) -> DataFrame:
    """Five text columns per key; bodies mix e-mail, phone, card, address and URL."""
    k = F.col(key).cast("bigint")
    first, last = pick(FIRST_NAMES, k), pick(LAST_NAMES, k)
    email, other = _email(first, last, k), _email(last, first, k + 7)
    card = F.concat_ws(" ", *[_digits(k, step, 1000, 9999) for step in (1009, 2003, 3001, 4007)])
    url = F.concat(F.lit("https://support."), pick(DOMAINS, k), F.lit("/t/"), k.cast("string"))
    host = _address(k)
    bodies = (
        F.format_string("Sign-in by %s failed from %s at 09:%02d.", email, host, k % 60),
        F.format_string("Card %s to be refunded; call %s this week.", card, _phone(k)),
        F.format_string("Trace at %s was sent by %s", url, email),
        F.format_string("Same as the ticket from %s (%s).", email, _phone(k)),
        F.lit("Pages load slowly; no personal data here."),
        F.format_string("Escalated by %s, copy to %s, host %s, ref #%d.", email, other, host, k + 100000),
    )
    body = F.when(k % len(bodies) == 0, bodies[0])
    for i, text in enumerate(bodies[1:], start=1):
        body = body.when(k % len(bodies) == i, text)
    return keys.select(
        F.format_string("TKT-%06d", k).alias("TicketID"),
        pick(PRIORITIES, k).alias("Priority"),
        F.concat(F.lit("Issue with order "), (k + 9000).cast("string")).alias("Subject"),
        body.alias("Body"),
        _email(last, F.lit("support"), k).alias("Assignee"),
    )


def make_contacts(spark: SparkSession, rows: int) -> DataFrame:
    return contacts(spark.range(1, rows + 1), "id")


def make_tickets(spark: SparkSession, rows: int) -> DataFrame:
    return tickets(spark.range(1, rows + 1), "id")
