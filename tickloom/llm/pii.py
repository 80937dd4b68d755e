"""PII: format-preserving Feistel pseudonyms.

Each value that its format's own rule validates (Luhn, mod 97, calendar, number plan, octets) is replaced by the image
of a keyed permutation of all valid values of that format. Equal values get equal pseudonyms in every document, different
ones stay different, and the holder of the key can invert the map. Nothing is shuffled: a pseudonym depends on the
value and the key alone. The key is the session's spark.tickloom.pii.key; a session without one draws one at random, so
that pseudonyms are linked within that application alone and nobody can turn them back.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import ipaddress
import math
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bound_batches, own_columns, quoted

#: Rounds of a permutation, characters that one permutes together, and permutations that a worker remembers.
ROUNDS, BLOCK, NETS = 10, 128, 4096
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
KEY = "spark.tickloom.pii.key"


@functools.cache
def _drawn(app_id: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The session's key, or one drawn at random, once for each application."""
    return spark.conf.get(KEY, None) or _drawn(spark.sparkContext.applicationId)


class Feistel:
    """A keyed permutation of range(n) for any n: additive Feistel over two residues, walked until the image is below n."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.size = (self.a.bit_length() + 7) // 8 + 8  # bytes of a round's digest: eight more than a half has
        self.base = hashlib.blake2b(tweak.encode() + b":" + n.to_bytes((n.bit_length() + 7) // 8, "big"), key=key[:64], digest_size=64)

    def _f(self, i: int, x: int) -> int:
        """A digest as wide as any half, block by block."""
        h = self.base.copy()
        h.update(b"%d:" % i + x.to_bytes((x.bit_length() + 7) // 8, "big"))
        out = b""
        for block in range(-(-self.size // 64)):
            own = h.copy()
            own.update(b"/%d" % block)
            out += own.digest()
        return int.from_bytes(out[: self.size], "big")

    def _once(self, x: int, sign: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if i % 2:
                right = (right + sign * self._f(i, left)) % self.b
            else:
                left = (left + sign * self._f(i, right)) % self.a
        return left * self.b + right

    def permute(self, x: int, sign: int = 1) -> int:
        """The image of x (sign 1), or the value whose image x is (sign -1)."""
        y = self._once(x, sign)
        while y >= self.n:
            y = self._once(y, sign)
        return y


#: Alphabets within which a character of a free-form value stays.
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LEAP_YEARS = [y for y in range(1900, 2100) if calendar.isleap(y)]
LATE_DAYS = [(m, d) for m in range(1, 13) for d in range(13, calendar.monthrange(2001, m)[1] + 1)]
#: Days (no leap day) of which the month or the day has one digit: all, and those that can only be read with the month first.
LOOSE_DAYS = [[(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(2001, m)[1] + 1) if (m < 10 or d < 10) and (d > 12 or not late)] for late in (False, True)]
#: How keys of known makes begin; that stays.
PREFIX = re.compile(r"(?:gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ)?")
#: First octets of addresses.
OCTETS = range(1, 256)
#: How long an IBAN is by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Groups of digits that card numbers are written in.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 5), (8, 8)}
#: Names of the months. A name that several lists have belongs to the first.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "abbreviated": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTH_OF = {name: (lang, m + 1) for lang, names in reversed(MONTHS.items()) for m, name in enumerate(names)}
MONTH_DAYS = {lang: {padded: [(m, d) for name, (x, m) in sorted(MONTH_OF.items()) if x == lang for d in range(1, 10 if padded else calendar.monthrange(2001, m)[1] + 1)] for padded in (False, True)} for lang in MONTHS}


@functools.cache
def alphabet(c: str) -> str:
    """The characters among which one of a free-form value stays: its ASCII class, else the letters of its kind in its row of 64; "" if it is no letter or digit."""
    for x in (LOWER, UPPER, DIGIT):
        if c in x:
            return x
    kind = unicodedata.category(c)
    return "".join(x for x in map(chr, range(ord(c) & ~63, (ord(c) | 63) + 1)) if unicodedata.category(x) == kind) if kind[0] == "L" else ""


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))


def nanp(digits: str) -> bool:
    """Whether ten digits are a number of the North American plan."""
    return digits[0] not in "01" and digits[3] not in "01"


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """The map of each kind of value, by key. sign -1 inverts it."""

    def __init__(self, key: str, sign: int = 1):
        self.key, self.sign, self.nets = key.encode(), sign, {}

    def _go(self, tweak: str, n: int, x: int) -> int:
        if (net := self.nets.get((tweak, n))) is None:
            if len(self.nets) >= NETS:
                self.nets.clear()
            net = self.nets[tweak, n] = Feistel(self.key, tweak, n)
        return net.permute(x, self.sign)

    def mixed(self, tweak: str, text: str, alphabets: list[str]) -> str:
        """text's characters as a number of mixed radix, permuted; an empty alphabet leaves its character.

        Longer texts go block by block, forward and then backward, each block under the pseudonym of its neighbour: every character of the result
        depends on every one of the text, and the time on the length.
        """
        if len(text) <= BLOCK:
            return self.radix(tweak, text, alphabets)
        parts = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        sets = [alphabets[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        for way in ("f", "b")[:: self.sign]:
            order = list(range(len(parts)))[:: 1 if way == "f" else -1]
            before = dict(zip(order[1:], order))
            for i in order[:: self.sign]:  # a block is permuted under its neighbour's pseudonym, which inverting reads before it turns that back
                beside = hashlib.blake2b(parts[before[i]].encode(), digest_size=16).hexdigest() if i in before else ""
                parts[i] = self.radix(f"{tweak}:{way}{i}:{beside}", parts[i], sets[i])
        return "".join(parts)

    def radix(self, tweak: str, text: str, alphabets: list[str]) -> str:
        n, x = 1, 0
        for c, alphabet in zip(text, alphabets):
            if alphabet:
                n, x = n * len(alphabet), x * len(alphabet) + alphabet.index(c)
        if n == 1:
            return text
        x, out = self._go(f"{tweak}:{''.join(a[:1] or '-' for a in alphabets)}", n, x), []
        for c, alphabet in zip(reversed(text), reversed(alphabets)):
            if alphabet:
                x, i = divmod(x, len(alphabet))
                c = alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    def classed(self, tweak: str, text: str, alnum: str = LOWER) -> str:
        return self.mixed(tweak, text, [alnum if c in alnum else alphabet(c) for c in text])

    @staticmethod
    def _laid(pattern: str, digits: str) -> str:
        """pattern with its digits replaced in order."""
        it = iter(digits)
        return re.sub(r"\d", lambda _: next(it), pattern)

    def email(self, s: str) -> str:
        head, dot, top = s.rpartition(".")
        return self.classed("email", head) + dot + top

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if len(d) == 10 or len(d) == 11 and d[0] == "1":
            head, d = d[:-10], d[-10:]
            if not nanp(d):
                # no number of that plan; with a country code it may still be somebody's, and stays outside the plan
                if not s.startswith("+"):
                    return None
                while nanp(d := f"{self._go('phone+', 10**10, int(d)):010d}"):
                    pass
                return self._laid(s, head + d)
            x = ((int(d[0]) - 2) * 100 + int(d[1:3])) * 8_000_000 + (int(d[3]) - 2) * 1_000_000 + int(d[4:])
            area, x = divmod(self._go("phone", 6_400_000_000, x), 8_000_000)
            first, rest = divmod(x, 1_000_000)
            return self._laid(s, f"{head}{area // 100 + 2}{area % 100:02d}{first + 2}{rest:06d}")
        if s.startswith("00") and 11 <= len(d) <= 17:
            return self._laid(s, d[:4] + f"{self._go('phone' + d[2:4], 10 ** (len(d) - 4), int(d[4:])):0{len(d) - 4}d}")
        if not s.startswith("+") or not 9 <= len(d) <= 15:
            return None
        return self._laid(s, d[:2] + f"{self._go('phone' + d[:2], 10 ** (len(d) - 2), int(d[2:])):0{len(d) - 2}d}")

    abroad = phone

    def card(self, s: str) -> tuple[int, str] | None:
        """The longest valid number that s begins with: all of s, or groups of digits as cards have them."""
        groups = list(re.finditer(r"\d+", s))
        for k in range(len(groups), 0, -1):
            d = "".join(g[0] for g in groups[:k])
            if len(d) < 13:
                break
            if len(d) > 19 or d[0] not in "23456" or luhn(d) % 10 or k < len(groups) and k > 1 and tuple(len(g[0]) for g in groups[:k]) not in CARD_GROUPS:
                continue
            body = d[0] + f"{self._go('card' + d[0], 10 ** (len(d) - 2), int(d[1:-1])):0{len(d) - 2}d}"
            return groups[k - 1].end(), self._laid(s[: groups[k - 1].end()], body + str(-luhn(body + "0") % 10))
        return None

    def iban(self, s: str) -> tuple[int, str] | None:
        """The number that s begins with: as long as its country's are, or all of s."""
        flat = s.replace(" ", "")
        places = [i for i, c in enumerate(s) if c != " "]
        for size in (IBAN_SIZES.get(flat[:2].upper(), 0), len(flat)):
            if not 15 <= size <= min(34, len(flat)) or s[places[size - 1] + 1 : places[size - 1] + 2] not in ("", " ") or mod97(flat[:size]) != 1:
                continue
            body = self.classed("iban" + flat[:2].upper(), flat[4:size])
            it, end = iter(f"{flat[:2]}{98 - mod97(flat[:2] + '00' + body):02d}{body}"), places[size - 1] + 1
            return end, "".join(c if c == " " else next(it) for c in s[:end])
        return None

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
        x, serial = divmod(self._go("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip6(self, s: str) -> str | None:
        """Each digit stays a digit in its place; an address with capitals keeps one at least."""
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return None
        if not re.search(r"\d", s) or len(re.findall("[0-9A-Fa-f]+", s)) < 3:
            return None
        upper = bool(re.search("[A-F]", s))
        if upper and re.search("[a-f]", s):
            return self.ip6(s.lower())
        out = s
        while out == s or upper and not re.search("[A-F]", out) or not re.search(r"\d", out):
            out = self.mixed("ip6", out, ["" if c == ":" else HEX.upper() if upper else HEX for c in out])
            if out == s:
                break
        return out

    def ip(self, s: str) -> str | None:
        a, *rest = parts = [int(x) for x in s.split(".")]
        if a not in OCTETS or max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        x = self._go("ip", len(OCTETS) << 24, OCTETS.index(a) << 24 | rest[0] << 16 | rest[1] << 8 | rest[2])
        return f"{OCTETS[x >> 24]}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"

    def date(self, s: str) -> str | None:
        sep = re.search(r"\D", s)[0]
        p = s.split(sep)
        order = (0, 1, 2) if len(p[0]) == 4 else (2, 1, 0) if int(p[1]) <= 12 else (2, 0, 1)  # day first unless it can't be
        y, m, d = (int(p[i]) for i in order)
        if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
            return None
        if min(len(p[i]) for i in order[1:]) == 1:
            # written without leading zeros, which another day must show too
            if any(p[i][0] == "0" for i in order[1:]):
                return None
            days = LOOSE_DAYS[order == (2, 0, 1)]
            if (m, d) == (2, 29):
                y = LEAP_YEARS[self._go("loose-leap", len(LEAP_YEARS), LEAP_YEARS.index(y))]
            else:
                y, x = divmod(self._go(f"loose{order}", 200 * len(days), (y - 1900) * len(days) + days.index((m, d))), len(days))
                y, (m, d) = y + 1900, days[x]
            new = dict(zip(order, (f"{y:04d}", str(m), str(d))))
            return sep.join(new[i] for i in range(3))
        if order == (0, 1, 2):
            # all days of two centuries
            day = datetime.date.fromordinal(FIRST_DAY + self._go("date", LAST_DAY - FIRST_DAY + 1, datetime.date(y, m, d).toordinal() - FIRST_DAY))
            return f"{day.year:04d}{sep}{day.month:02d}{sep}{day.day:02d}"
        if order == (2, 1, 0):
            day = datetime.date.fromordinal(FIRST_DAY + self._go("date-dmy", LAST_DAY - FIRST_DAY + 1, datetime.date(y, m, d).toordinal() - FIRST_DAY))
            return f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year:04d}"
        # month first: only days after the 12th are read so, and leap days are permuted among themselves
        if (m, d) == (2, 29):
            y = LEAP_YEARS[self._go("date-leap", len(LEAP_YEARS), LEAP_YEARS.index(y))]
        else:
            y, x = divmod(self._go("date-mdy", 200 * len(LATE_DAYS), (y - 1900) * len(LATE_DAYS) + LATE_DAYS.index((m, d))), len(LATE_DAYS))
            y, (m, d) = y + 1900, LATE_DAYS[x]
        return f"{m:02d}{sep}{d:02d}{sep}{y:04d}"

    def written(self, s: str) -> str | None:
        """A date with the name of its month: day and year are written as before, the month in the same language and case."""
        name, numbers = re.search(r"[^\W\d_]{3,}(?<!th)", re.sub(r"\d(?:st|nd|rd|th)\b", "0..", s))[0], re.findall(r"\d+", s)
        lang, m = MONTH_OF[name.lower()]
        day, y = numbers[0], int(numbers[1])
        padded, d = day[0] == "0", int(day)
        if not (1900 <= y <= 2099 and 1 <= d <= calendar.monthrange(y, m)[1]):
            return None
        days = MONTH_DAYS[lang][padded]
        if (m, d) == (2, 29):
            y = LEAP_YEARS[self._go("written-leap", len(LEAP_YEARS), LEAP_YEARS.index(y))]
        else:
            y, x = divmod(self._go(f"written-{lang}-{padded}", 200 * len(days), (y - 1900) * len(days) + days.index((m, d))), len(days))
            y, (m, d) = y + 1900, days[x]
        new = MONTHS[lang][m - 1]
        new = new.upper() if name.isupper() else new.capitalize() if name[0].isupper() else new
        out = s.replace(name, "\0", 1)
        ordinal = "th" if 10 <= d % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
        out = re.sub(rf"\b{numbers[1]}\b", f"{y:04d}", re.sub(rf"\b{day}(st|nd|rd|th)?(?!\d)", lambda g: f"{d:02d}" if padded and not g[1] else f"{d}{ordinal if g[1] else ''}", out, count=1))
        return out.replace("\0", new)

    def secret(self, s: str) -> str:
        if s.startswith("AKIA") and len(s) == 20:
            return "AKIA" + self.mixed("akia", s[4:], [UPPER + DIGIT] * 16)
        if re.fullmatch(r"[0-9a-f]{8,}", s):
            return self.mixed("hex", s, [HEX] * len(s))
        prefix = PREFIX.match(s)[0]
        return prefix + self.classed("secret" + prefix, s[len(prefix) :])

    def cued(self, s: str) -> str | None:
        """A number that a word announces as a telephone's: one of the plan, or all digits but the first."""
        d = re.sub(r"\D", "", s)
        if (out := self.phone(s)) is not None or not 7 <= len(d) <= 13:
            return out
        head, d = (d[:-10], d[-10:]) if len(d) == 10 or len(d) == 11 and d[0] == "1" else (d[:1], d[1:])
        outside = len(d) == 10 and head in ("", "1")  # such numbers stay outside the plan
        while (d := f"{self._go(f'cued{len(d)}', 10 ** len(d), int(d)):0{len(d)}d}") and outside and nanp(d):
            pass
        return self._laid(s, head + d)


NAMES = "|".join(sorted(MONTH_OF, key=len, reverse=True))
#: One pass over a text; the first alternative that matches at a place is tried, and what its format's rule rejects is searched again from the next character on.
PATTERN = re.compile(
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s(?P<pem>[A-Za-z0-9+/=\s]{40,})-----END|(?<!\w)(?:"
    r"(?P<email>(?u:(?<![\w.+%\u0300-\u036f-])\w[\w.%+\u0300-\u036f-]*@(?:[\w\u0300-\u036f-]+\.)+[^\W\d_]{2,}(?![\w-])))"
    r"|(?P<secret>\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9]{20,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[\w-]{35}(?![\w-])|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
    r"|(?i:\bbearer\s{1,3})(?P<bearer>[A-Za-z0-9._~+/=-]{16,})"
    r"|(?i:\b(?:tel|phone|telephone|telefon|fon|fax|mobil|mobile)\b\.?:?\s{0,3})(?P<cued>\+?\(?\d[\d ()/.-]{5,17}\d)(?![\w-])"
    r"|(?=[PSTApsta])(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[^\s\"',;]{6,})"
    r"|(?P<iban>(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?:(?=T\d\d:)|(?![\w/-])))"
    r"|(?P<written>(?<![\w./-])(?iu:\d{1,2}(?:st|nd|rd|th)?\.?\s{1,3}(?:(?:of|de)\s)?(?:" + NAMES + r")\.?(?:\sde|,)?\s{1,3}\d{4}|(?=\w{3,10}\.?\s{1,3}\d)(?:" + NAMES + r")\.?\s{1,3}\d{1,2}(?:st|nd|rd|th)?,?\s{1,3}\d{4})(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?<![vV]ersion )\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]{3,38}(?<!:)(?![\w.:]))"
    r"|(?P<abroad>(?<![\w+.-])00[1-9]\d{0,2}[ .-]\d{1,4}(?:[ .-]?\d{2,9}){1,4}(?![\w-]))"
    r"|(?P<card>(?<![\w+-])(?:\d{4}(?:\.\d{4}){3}|\d(?:[ -]?\d){12,18})(?!\w|-\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])))",
    re.ASCII,
)
#: Whatever PATTERN matches holds one of these; keys may be of letters alone.
HINT = re.compile(r"[0-9@]|(?:AKIA|gh[pousr]_|sk-)[A-Za-z0-9]{16}|xox[abprs]-|AIza|eyJ|PRIVATE KEY|(?i:bearer)\s|(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]")
#: What a group of PATTERN counts as, where it isn't named so.
COUNTED = {"value": "secret", "bearer": "secret", "pem": "secret", "cued": "phone", "abroad": "phone", "written": "date", "ip6": "ip"}


def pseudonymize_text(text: str, names: Pseudonyms, counts: dict[str, int]) -> str:
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        new = names.secret(m[kind]) if kind in ("value", "bearer", "pem") else getattr(names, kind)(m[kind])
        if new is None:
            at = m.start() + 1
            continue
        size, new = new if isinstance(new, tuple) else (len(m[kind]), new)
        begin, at = m.start(kind), m.start(kind) + size
        out += [text[done:begin], new]
        done = at
        counts[COUNTED.get(kind, kind)] += 1
    return "".join([*out, text[done:]]) if done else text


def pseudonymize(df: DataFrame, text: str = "text", key: str | None = None, sign: int = 1, counts: bool = True) -> DataFrame:
    """df with its text pseudonymised; with counts, also n_pii and a column n_<kind> for each kind.

    A null text stays null with zero counts, an empty one stays empty. Other columns, repeated rows and their number are
    left as they are; columns named like the counts are replaced. sign -1 turns pseudonyms back. Without a key, that of the session
    counts.
    """
    bound_batches(df.sparkSession)
    key = key or session_key(df.sparkSession)
    schema = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, T.LongType()) for k in KINDS)])

    @F.pandas_udf(schema)
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(key, sign)
        for texts in batches:
            out, found = [], []
            for x in texts:
                n = dict.fromkeys(KINDS, 0)
                out.append(pseudonymize_text(x, names, n) if x and HINT.search(x) else x)
                found.append(n)
            yield pd.concat([pd.DataFrame({"text": pd.Series(out, dtype=object)}), pd.DataFrame(found, columns=KINDS, dtype="int64")], axis=1)

    made = {f"n_{k}": k for k in KINDS} if counts else {}
    keep = own_columns(df, *made, *(["n_pii"] if counts else []))
    done = df.select(*(F.col(quoted(c)) for c in keep), go(F.col(quoted(text))).alias("__pii"))
    out = [F.col("__pii.text").alias(c) if c == text else F.col(quoted(c)) for c in keep]
    if counts:
        out += [sum((F.col(f"__pii.{k}") for k in KINDS), F.lit(0).cast("long")).alias("n_pii"), *(F.col(f"__pii.{k}").alias(c) for c, k in made.items())]
    return done.select(*out)
