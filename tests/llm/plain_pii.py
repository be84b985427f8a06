"""The pseudonyms once more in plain Python, value by value, for comparison."""

import datetime as dt
import hashlib

import regex

from entitylink.llm import pii


def ascii_digits(pattern):
    """Java's \\d is 0-9."""
    out, inside = "", False
    k = 0
    while k < len(pattern):
        c = pattern[k : k + 2]
        if c == r"\d":
            out += "0-9" if inside else "[0-9]"
            k += 2
            continue
        if c[0] == "\\":
            out += c
            k += 2
            continue
        inside = inside or c[0] == "["
        if c[0] == "]":
            inside = False
        out += c[0]
        k += 1
    return out


PATTERN = regex.compile("|".join(f"(?P<{n}>{ascii_digits(p.replace(chr(92) + '1', '(?P=gap)').replace('([ -])', '(?P<gap>[ -])'))})" for n, p in (("email", pii.EMAIL), ("ip", pii.IP), ("date", pii.DATE), ("ssn", pii.SSN), ("iban", pii.IBAN), ("phone", pii.PHONE), ("card", pii.CARD))))


def prf(fmt, i, part):
    return int(hashlib.sha256(f"{pii.KEY}|{fmt}|{i}|{part}".encode()).hexdigest()[:15], 16)


def feistel(a, b, m, n, fmt):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + prf(fmt, i, b)) % m
        else:
            b = (b + prf(fmt, i, a)) % n
    return a, b


def digits(d, fmt):
    if len(d) < 2:
        return str((int(d) + prf(fmt, 0, "") % 9 + 1) % 10) if d else ""
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), fmt)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def only(m):
    return "".join(c for c in m if c in "0123456789")


def fill(m, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def card(m):
    d = only(m)
    if not 13 <= len(d) <= 19 or luhn(d):
        return m
    p = digits(d[:-1], "card")
    return fill(m, p + next(c for c in "0123456789" if luhn(p + c) == 0))


def iban(m):
    p = m.replace(" ", "")
    if not 15 <= len(p) <= 34 or mod97(p[4:] + p[:4]) != 1:
        return m
    body = fill(p[4:], digits(only(p[4:]), "iban"))
    plain = iter(p[:2] + f"{98 - mod97(body + p[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(plain) for c in m)


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or group < 1 or serial < 1:
        return m
    s, t = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    return f"{s // 99 + 1 + (s // 99 >= 665):03d}-{s % 99 + 1:02d}-{t + 1:04d}"


def date(m):
    sep = next(c for c in m if c in "/.-")
    p = m.split(sep)
    year_first = len(p[0]) == 4
    month_first = not year_first and int(p[1]) > 12
    y, mo, d = (p[0], p[1], p[2]) if year_first else (p[2], p[0], p[1]) if month_first else (p[2], p[1], p[0])
    try:
        day = dt.date(int(y), int(mo), int(d))
    except ValueError:
        return m
    if not 1900 <= day.year <= 2099:
        return m
    start = dt.date(1900, 1, 1)
    while True:
        k = (day - start).days
        a, b = feistel(k // 4297, k % 4297, 17, 4297, "date-month-first" if month_first else "date")
        day = start + dt.timedelta(a * 4297 + b)
        if not month_first or day.day > 12:
            break
    dd, mm = (f"{day.day:02d}", f"{day.month:02d}") if len(m) == 10 else (str(day.day), str(day.month))
    return sep.join([str(day.year), mm, dd] if year_first else [mm, dd, str(day.year)] if month_first else [dd, mm, str(day.year)])


def phone(m):
    d = only(m)
    if not 8 <= len(d) <= 15:
        return m
    code = regex.match(ascii_digits(pii.CALLING_CODE), d).group() if m[0] == "+" else ""
    return fill(m, code + digits(d[len(code) :], "phone"))


def moved(c, k, single):
    on = lambda at, n: (at + (1 + k % (n - 1) if single else k)) % n
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", pii.SMALL, pii.CAPITAL):
        if c in alphabet:
            return alphabet[on(alphabet.index(c), len(alphabet))]
    v = ord(c)
    return chr(v - v % 16 + on(v % 16, 16)) if regex.match(r"[\p{L}\p{N}]", c) else c


def email(m):
    whole, domain = m.split("@")
    lead = regex.match(r"[^\p{L}\p{N}]*", whole).group()
    local = whole[len(lead) :]
    single = len(local) == 1
    a, b = local[: len(local) // 2], local[len(local) // 2 :]

    def shift(part, i, other):
        h = hashlib.sha256("|".join([pii.KEY, "email", str(i), domain.lower(), other]).encode()).digest()
        return "".join(moved(c, h[j % 32], single) for j, c in enumerate(part))

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = shift(a, i, b)
        elif not single or i == 1:
            b = shift(b, i, a)
    return f"{lead}{a}{b}@{domain}"


def pseudonymise(text):
    """(the new text, values that changed)"""
    if not text:
        return text, 0
    n = 0

    def swap(m):
        nonlocal n
        new = globals()[m.lastgroup if m.lastgroup != "gap" else "card"](m.group())
        n += new != m.group()
        return new

    return PATTERN.sub(swap, text), n
