"""Validators and scalar functions: Column -> Column, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.positions import let


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def digits_only(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def number(v: Column) -> Column:
    return v.try_cast("long")


def chars(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit(r"(?s)."), F.lit(0))


def distinct_chars(v: Column) -> Column:
    return F.size(F.array_distinct(chars(v)))


def entropy(v: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty text."""
    n = F.length(v)

    def add(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(v, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars(v)), F.lit(0.0), add))


# ---- payment cards
def luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def card_brand(d: Column) -> Column:
    n = F.length(d)
    p = lambda k: number(F.substring(d, 1, k))
    p2, p3, p4, p6 = p(2), p(3), p(4), p(6)
    return (
        F.when(~d.rlike(r"^[0-9]{13,}$"), F.lit(None))
        .when(d.startswith("4") & n.isin(13, 16, 19), "visa")
        .when((n == 16) & (p2.between(51, 55) | p4.between(2221, 2720)), "mastercard")
        .when((n == 15) & p2.isin(34, 37), "amex")
        .when(n.between(16, 19) & ((p4 == 6011) | (p2 == 65) | p3.between(644, 649) | p6.between(622126, 622925)), "discover")
        .when(n.between(14, 19) & (p3.between(300, 305) | (p3 == 309) | p2.isin(36, 38, 39)), "diners")
        .when(n.between(16, 19) & p4.between(3528, 3589), "jcb")
        .when(n.between(16, 19) & (p2 == 62), "unionpay")
    )


def expiry(v: Column) -> Column:
    """MM/YY, or MM/YYYY of the years 2000 to 2099."""
    parts = F.split(F.trim(v), r"[ \t]*[/\-.|][ \t]*", -1)
    month, year = F.get(parts, 0), F.get(parts, 1)
    ok = (F.size(parts) == 2) & month.rlike("^[0-9]+$") & number(month).between(1, 12) & year.rlike("^(?:[0-9]{2}|20[0-9]{2})$")
    return F.coalesce(ok, F.lit(False))


# ---- bank identifiers
def mod97(v: Column) -> Column:
    """Whether letters as numbers, first four characters last, leave 1 modulo 97."""
    moved = F.concat(F.substring(v, 5, 99), F.substring(v, 1, 4))
    values = F.transform(chars(moved), lambda c: F.when(c.rlike("[0-9]"), number(c)).otherwise(F.ascii(c) - 55).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, d: ((a * F.when(d > 9, 100).otherwise(10) + d) % 97).cast("int")) == 1


def iban(v: Column) -> Column:
    s = F.upper(F.regexp_replace(v, r"[ \-]", ""))
    lengths = F.create_map(*[F.lit(x) for kv in fixed.IBAN_LENGTHS.items() for x in kv])
    shape = (F.length(s) == F.try_element_at(lengths, F.substring(s, 1, 2))) & s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$")
    return F.when(F.coalesce(shape, F.lit(False)), mod97(s)).otherwise(False)


def aba(d: Column) -> Column:
    prefix = number(F.substring(d, 1, 2))
    weights = (3, 7, 1) * 3
    total = sum((number(F.substring(d, i + 1, 1)) * w for i, w in enumerate(weights)), F.lit(0))
    ok = d.rlike("^[0-9]{9}$") & ((prefix <= 12) | prefix.between(21, 32) | prefix.between(61, 72) | (prefix == 80)) & (total % 10 == 0)
    return F.coalesce(ok, F.lit(False))


def swift(v: Column) -> Column:
    return v.rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$") & F.substring(v, 5, 2).isin(fixed.COUNTRIES)


def bank_account(v: Column) -> Column:
    d = digits_only(v)
    return F.length(d).between(6, 17) & (distinct_chars(d) > 1)


# ---- government, tax and health identifiers
def ssn(v: Column) -> Column:
    return F.trim(v).rlike(r"^(?!000|666|9)\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}$")


def tax_id(v: Column) -> Column:
    s = F.trim(v)
    prefix = number(F.substring(s, 1, 2))
    ein = F.lit(False)
    for a, b in fixed.EIN_RANGES:
        ein = ein | prefix.between(a, b)
    return F.when(s.rlike(r"^\d{2}-?\d{7}$"), ein).otherwise(s.rlike(r"^[A-Z]{2}[ ]?[A-Z0-9]{8,12}$") & F.substring(s, 1, 2).isin(fixed.EU_VAT))


def record_id(v: Column) -> Column:
    """6 to 20 letters and digits, at least 3 digits; not shaped like a date or a phone number."""
    s = F.regexp_replace(F.upper(F.trim(v)), "[ -]", "")
    digits = F.length(digits_only(s))
    only = s.rlike(r"^\d+$")
    dated = only & (((digits == 8) & number(F.substring(s, 1, 2)).between(1, 12)) | (digits == 10))
    return F.length(s).between(6, 20) & (digits >= 3) & ~F.coalesce(dated, F.lit(False)) & (s.rlike(r"\p{L}") | (digits >= 6))


# ---- contact and network
def email(v: Column) -> Column:
    local = F.regexp_extract(v, r"^(.*)@", 1)
    domain = F.regexp_extract(v, r"@([^@]*)$", 1)
    labels = F.split(domain, r"\.", -1)
    tld = F.lower(F.element_at(labels, -1))
    return (
        F.length(local).between(1, 64) & ~v.contains("..") & ~local.startswith(".") & ~local.endswith(".") & (F.length(domain) <= 253)
        & (F.size(labels) >= 2) & F.forall(labels, lambda x: F.length(x).between(1, 63)) & tld.rlike(r"^\p{L}{2,}$") & ~tld.isin(fixed.FILE_TLDS)
    )


def phone_cued(v: Column) -> Column:
    d = digits_only(v)
    shaped = F.trim(v).rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\d{4}[-/.]\d{2}[-/.]\d{2})$")
    return F.length(d).between(7, 15) & (distinct_chars(d) > 1) & ~shaped


def phone_e164(v: Column) -> Column:
    d = digits_only(v)
    return F.length(d).between(8, 15) & ~d.startswith("0") & (distinct_chars(d) > 1)


def phone_nanp(v: Column) -> Column:
    d = F.regexp_replace(digits_only(v), r"^1(?=\d{10}$)", "")
    return (F.length(d) == 10) & (distinct_chars(d) > 1) & d.rlike(r"^[2-9](?!11)\d\d[2-9](?!11)\d\d")


def ipv4_number(v: Column) -> Column:
    """The address as a long; null if it isn't one."""
    p = F.split(v, r"\.", -1)
    n = sum((number(F.get(p, i)) * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return F.when(v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"), n)


def in_blocks(n: Column, blocks) -> Column:
    """Whether an IPv4 number is in one of the blocks 'a.b.c.d/bits'."""
    found = F.lit(False)
    for block in blocks:
        base, bits = block.split("/")
        first = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(base.split(".")))
        found = found | n.between(first, first + 2 ** (32 - int(bits)) - 1)
    return found


#: The special-purpose registries of IPv4.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
GLOBAL_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")


def is_netmask(v: Column) -> Column:
    p = F.transform(F.split(v, r"\.", -1), number)
    masks = F.array(*[F.lit(x).cast("long") for x in (0, 128, 192, 224, 240, 248, 252, 254, 255)])
    ok = (F.size(p) == 4) & (F.get(p, 0) == 255) & F.forall(p, lambda x: F.array_contains(masks, x)) & (p == F.sort_array(p, asc=False))
    return F.coalesce(ok, F.lit(False))


def ipv4(v: Column) -> Column:
    """An address that isn't a netmask, loopback, unspecified, multicast or broadcast."""
    odd = ("127.0.0.0/8", "0.0.0.0/32", "224.0.0.0/4", "255.255.255.255/32")
    return let(ipv4_number(v), lambda n: F.when(n.isNull(), False).otherwise(~in_blocks(n, odd) & ~is_netmask(v)))


def ipv4_private(v: Column) -> Column:
    return let(ipv4_number(v), lambda n: F.coalesce(in_blocks(n, PRIVATE_BLOCKS) & ~in_blocks(n, GLOBAL_EXCEPTIONS), F.lit(False)))


def ipv4_global(n: Column) -> Column:
    """Of an IPv4 number: globally reachable and not multicast."""
    return ~(in_blocks(n, (*PRIVATE_BLOCKS, "100.64.0.0/10", "224.0.0.0/4")) & ~in_blocks(n, GLOBAL_EXCEPTIONS))


def ipv6_groups(v: Column) -> Column:
    """The eight groups of an IPv6 address as ints; null if it isn't one. An IPv4 tail counts as two groups."""
    def unmixed(t: Column) -> Column:
        tail, n = t["tail"], t["n"]
        low = F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(tail == "", t["v"]).when(n.isNotNull(), F.concat(F.substring(t["v"], F.lit(1), F.length(t["v"]) - F.length(tail)), low))

    part = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")

    def whole(s: Column) -> Column:
        shape = s.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::)?(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$") & ~s.rlike(":::|::.*::")
        halves = F.transform(F.split(s, "::", -1), part)
        return F.when(shape, let(halves, padded))

    def padded(h: Column) -> Column:
        left, right = F.get(h, 0), F.coalesce(F.get(h, 1), F.array().cast("array<string>"))
        have = F.size(left) + F.size(right)
        full = F.when((F.size(h) == 1) & (have == 8), left).when((F.size(h) == 2) & (have <= 7), F.concat(left, F.array_repeat(F.lit("0"), 8 - have), right))
        return F.transform(full, lambda g: F.conv(g, 16, 10).cast("int"))

    tail = F.regexp_extract(v, r":((?:\d{1,3}\.){3}\d{1,3})$", 1)
    mixed = let(tail, lambda t: F.struct(v.alias("v"), t.alias("tail"), ipv4_number(t).alias("n")))
    return let(let(mixed, unmixed), whole)


def ipv6(v: Column) -> Column:
    """An IPv6 address of at least four hex digits that isn't loopback or unspecified."""
    def judged(g: Column) -> Column:
        low = F.aggregate(F.slice(g, 1, 7), F.lit(0), lambda a, x: a + x)
        return g.isNotNull() & (F.length(F.regexp_replace(v, "[^0-9A-Fa-f]", "")) >= 4) & ~((low == 0) & F.element_at(g, 8).isin(0, 1))

    return F.coalesce(let(ipv6_groups(v), judged), F.lit(False))


def ipv6_global(g: Column) -> Column:
    """Of eight groups: an address that carries an IPv4 one is judged by that, others by their block."""
    e = lambda i: F.element_at(g, i)
    pair = lambda i: e(i).cast("long") * 65536 + e(i + 1)
    zero = lambda n: F.aggregate(F.slice(g, 1, n), F.lit(0), lambda a, x: a + x) == 0
    documented = ((e(1) == 0x2001) & (e(2) == 0x0DB8)) | ((e(1) == 0x3FFF) & (e(2) < 0x1000))
    protocol = (e(1) == 0x2001) & (e(2) < 0x0200) & ~((e(2) == 1) & (F.aggregate(F.slice(g, 3, 5), F.lit(0), lambda a, x: a + x) == 0) & e(8).isin(1, 2)) & ~(
        (e(2) == 3) | ((e(2) == 4) & (e(3) == 0x112)) | e(2).between(0x20, 0x3F)
    )
    private = (zero(7) & (e(8) <= 1)) | ((e(1) == 0x64) & (e(2) == 0xFF9B) & (e(3) == 1)) | ((e(1) == 0x100) & (e(2) == 0) & (e(3) == 0) & (e(4) == 0)) | protocol | documented
    private = private | e(1).between(0xFC00, 0xFDFF) | e(1).between(0xFE80, 0xFEBF) | (e(1) == 0x5F00)
    return (
        F.when(zero(5) & (e(6) == 0xFFFF), let(pair(7), ipv4_global))
        .when((e(1) == 0x64) & (e(2) == 0xFF9B) & (F.aggregate(F.slice(g, 3, 4), F.lit(0), lambda a, x: a + x) == 0), let(pair(7), ipv4_global))
        .when(e(1) == 0x2002, let(pair(2), ipv4_global))
        .otherwise(~private & (e(1) < 0xFF00))
    )


def publicly_routable(v: Column) -> Column:
    """Provably a globally reachable address; anything that can't be parsed isn't."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(v), r"^\[(.*)\]$", "$1"), "%.*$", "")
    both = let(bare, lambda s: F.struct(ipv4_number(s).alias("n"), ipv6_groups(s).alias("g")))
    judged = lambda t: F.when(t["n"].isNotNull(), ipv4_global(t["n"])).when(t["g"].isNotNull(), ipv6_global(t["g"]))
    return F.coalesce(let(both, judged), F.lit(False))


def url_part(v: Column, part: str) -> Column:
    return F.try_parse_url(v, F.lit(part))


def internal_host(host: Column, suffixes=fixed.INTERNAL_SUFFIXES) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), r"\.+$", "")

    def judged(t: Column) -> Column:
        h, n, g = t["h"], t["n"], t["g"]
        named = F.lit(False)
        for s in suffixes:
            named = named | (h == s) | h.endswith("." + s)
        private = in_blocks(n, PRIVATE_BLOCKS) & ~in_blocks(n, GLOBAL_EXCEPTIONS)
        return (
            F.when((h == "") | (h == "localhost"), False)
            .when(n.isNotNull(), private & ~in_blocks(n, ("127.0.0.0/8", "0.0.0.0/32")))
            .when(g.isNotNull(), ~ipv6_global(g) & ipv6(h) & (F.element_at(g, 1) < 0xFF00))
            .otherwise(~h.contains(".") | named)
        )

    parts = let(bare, lambda h: F.struct(h.alias("h"), ipv4_number(h).alias("n"), ipv6_groups(h).alias("g")))
    return F.coalesce(let(parts, judged), F.lit(False))


def internal_url(v: Column, suffixes=fixed.INTERNAL_SUFFIXES) -> Column:
    return internal_host(F.regexp_extract(v, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), suffixes)


def internal_hostname(v: Column, suffixes=fixed.INTERNAL_SUFFIXES, tenant=()) -> Column:
    """A tenant's host always; under a generic suffix two labels, or one with a digit or hyphen."""
    h = F.lower(v)
    out = F
    for t in tenant:
        out = out.when((h == t) | h.endswith("." + t), True)
    for s in sorted(suffixes, key=len, reverse=True):
        head = F.substring(h, F.lit(1), F.length(h) - len(s) - 1)
        out = out.when(h.endswith("." + s), head.contains(".") | F.substring_index(head, ".", 1).rlike(r"[\d-]"))
    return out.otherwise(False)


# ---- crypto addresses
def base58check(v: Column) -> Column:
    """25 bytes whose last four are the double SHA-256 of the others, of a known version."""
    values = F.transform(chars(v), lambda c: F.instr(F.lit(fixed.BASE58), c) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), 25).alias("b"), F.lit(0).alias("over"))

    def times58(acc: Column, c: Column) -> Column:
        first = F.struct(F.array().cast("array<int>").alias("b"), c.alias("over"))
        step = lambda s, x: F.struct(F.concat(s["b"], F.array((x * 58 + s["over"]).bitwiseAND(255))).alias("b"), F.shiftright(x * 58 + s["over"], 8).alias("over"))
        return let(F.aggregate(acc["b"], first, step), lambda s: F.struct(s["b"].alias("b"), (acc["over"] + s["over"]).cast("int").alias("over")))

    def check(s: Column) -> Column:
        raw = F.array_join(F.transform(F.reverse(s["b"]), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
        digest = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(raw, 1, 42)), 256)), 256)
        return (s["over"] == 0) & (F.upper(F.substring(digest, 1, 8)) == F.substring(raw, 43, 8)) & F.substring(raw, 1, 2).isin("00", "05", "6F", "C4")

    return F.when(F.forall(values, lambda x: x >= 0), let(F.aggregate(values, zero, times58), check)).otherwise(False)


def bech32(v: Column) -> Column:
    """Checksum of bech32 or bech32m."""
    a = F.lower(v)
    cut = F.length(a) - F.instr(F.reverse(a), "1")
    head, data = F.substring(a, F.lit(1), cut), F.substring(a, cut + 2, F.length(a))
    values = F.transform(chars(data), lambda c: F.instr(F.lit(fixed.BECH32), c) - 1)
    h = chars(head)
    full = F.concat(F.transform(h, lambda c: F.shiftright(F.ascii(c), 5)), F.array(F.lit(0)), F.transform(h, lambda c: F.ascii(c).bitwiseAND(31)), values)

    def step(chk: Column, x: Column) -> Column:
        top = F.shiftright(chk, 25)
        out = F.shiftleft(chk.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(x.cast("long"))
        for i, g in enumerate(fixed.BECH32_GENERATOR):
            out = out.bitwiseXOR(F.when(F.shiftright(top, i).bitwiseAND(1) == 1, F.lit(g).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    sound = ((v == a) | (v == F.upper(v))) & (cut >= 1) & (F.length(a) - cut >= 7) & (F.length(a) <= 90) & F.forall(values, lambda x: x >= 0)
    return F.when(sound, F.aggregate(full, F.lit(1).cast("long"), step).isin(1, 0x2BC830A3)).otherwise(False)


# ---- tokens, keys and secrets
def unbase64(v: Column) -> Column:
    """Bytes of base64 without padding; null if it isn't that."""
    bare = F.regexp_replace(v, "=+$", "")
    return F.when(F.length(bare) % 4 != 1, F.try_to_binary(F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)))), F.lit("base64")))


def jwt(v: Column) -> Column:
    p = F.split(v, r"\.", -1)
    text = lambda i: unbase64(F.translate(F.get(p, i), "-_", "+/")).cast("string")
    header, payload = F.try_parse_json(text(0)), F.try_parse_json(text(1))
    ok = (F.size(p) == 3) & F.get_json_object(text(0), "$.alg").isNotNull() & header.isNotNull() & payload.isNotNull() & text(1).rlike(r"^\s*[\[{]")
    return F.coalesce(ok, F.lit(False))


def basic_auth(v: Column) -> Column:
    raw = unbase64(v).cast("string")
    return F.coalesce(raw.contains(":") & raw.rlike(r"^[ -~]*$"), F.lit(False))


def pem(v: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(v, r"\\r\\n|\\n", "\n"), r"\r\n|\r|\n", -1), F.trim)
    body = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("-----") & ~x.contains(":") & ~x.startswith("=")), "")
    body = F.replace(body, F.lit("\\r"), F.lit(""))
    return (F.length(body) >= 40) & body.rlike(r"^[A-Za-z0-9+/]*=*$") & unbase64(body).isNotNull()


def looks_like_reference(v: Column) -> Column:
    return v.rlike(fixed.REFERENCE) | v.contains("(") | v.endswith(")")


def secret_value(v: Column, least_entropy: float, least: int) -> Column:
    return (F.length(v) >= least) & ~v.rlike(fixed.PLACEHOLDER) & ~looks_like_reference(v) & (entropy(v) >= least_entropy)


def hex_key(v: Column) -> Column:
    """128 bits and more in hex digits, which aren't a pattern of a few. Of 16 letters there are 4 bits a character at most, so a gate for
    values of all letters drops random ones too: at 3.2 bits some 2 of 10,000 of 40 digits."""
    return v.rlike(r"(?i)^[0-9a-f]{32,}$") & (entropy(v) >= 2.5)


def password_value(v: Column) -> Column:
    s = F.trim(v)
    return (F.length(s) >= 3) & ~F.lower(s).isin(fixed.NOT_SECRETS) & ~s.rlike(fixed.PLACEHOLDER) & ~looks_like_reference(s) & ~s.rlike("^[A-Z_]{4,}$")


def connection_string(v: Column) -> Column:
    lower = F.lower(v)
    has_password = v.rlike(r"^[^:/?#]+://[^/?#@:]*:[^/?#]+@")
    return lower.startswith("jdbc:") | has_password | F.regexp_extract(lower, r"^([a-z0-9+.\-]+)://", 1).isin(fixed.DB_SCHEMES)


def seed_words(v: Column) -> Column:
    w = F.split(F.trim(v), r"[ \t,\-]+", -1)
    stop = F.filter(w, lambda x: F.lower(x).isin(fixed.SEED_STOPWORDS))
    return F.size(w).between(12, 24) & F.forall(w, lambda x: x.rlike(r"^\p{L}+$")) & (F.size(stop) <= 2)


def seed_token(v: Column) -> Column:
    s = F.trim(v)
    shaped = F.when(s.contains("-"), F.forall(F.split(s, "-", -1), lambda x: x.rlike(r"^[\p{L}\p{N}]+$"))).otherwise(s.rlike(r"\d"))
    return ~F.lower(s).isin(fixed.NOT_SECRETS) & ~s.rlike(fixed.PLACEHOLDER) & shaped


def intl_password(v: Column) -> Column:
    s = F.trim(v)
    texture = s.rlike(r"\p{Nd}") | s.rlike(r"[^\p{L}\p{N}]") | (s.rlike(r"\p{Lu}") & s.rlike(r"\p{Ll}"))
    return (F.length(s) >= 6) & ~F.lower(s).isin(fixed.NOT_SECRETS) & ~s.rlike(fixed.PLACEHOLDER) & ~looks_like_reference(s) & texture


# ---- statistics
def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the 95 % interval of a proportion; (0, 0) for n = 0."""
    p = k / n
    d = 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    h = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    zero = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return F.when(n == 0, zero).otherwise(F.struct(F.greatest(c - h, F.lit(0.0)).alias("low"), F.least(c + h, F.lit(1.0)).alias("high")))


def text_key(v: Column) -> Column:
    return F.substring(F.sha1(v), 1, 16)


def conversation_id(v: Column) -> Column:
    """The id if it is well formed, else null."""
    return F.when(v.rlike(r"^[A-Za-z0-9_.:-]{1,64}$"), v)


def label_name(v: Column) -> Column:
    return F.when(v.rlike(r"^[A-Z][A-Z0-9_]{0,63}$"), v).otherwise("UNKNOWN")
