"""A detector and pseudonyms in plain Python, written from the definitions: what ``kinelytics.llm.pii`` is compared with."""

import hashlib
import re
from datetime import date, timedelta

from kinelytics.llm.pii import IBAN_SIZES

SIZES = {c: n for n, names in IBAN_SIZES.items() for c in names.split()}
MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
PHONES = [re.compile(p, re.ASCII) for p in (r"\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){6,13}(?!\d)", r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)", r"[2-9]\d{2}-\d{3}-\d{4}(?!\d|-\d)")]
ASCII = re.ASCII


def digit(c):
    return "0" <= c <= "9"


def alnum(c):
    return digit(c) or "A" <= c <= "Z" or "a" <= c <= "z"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def as_date(s):
    """``(day, format)`` of an existing date in one of the three forms."""
    for pattern, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(\d\d)\.(\d\d)\.(\d{4})", "dmy"), (r"(\d\d)/(\d\d)/(\d{4})", "mdy")):
        if found := re.fullmatch(pattern, s, ASCII):
            part = dict(zip(order, map(int, found.groups())))
            try:
                return (date(part["y"], part["m"], part["d"]), order) if 1900 <= part["y"] <= 2099 else None
            except ValueError:
                return None
    return None


def cards(text):
    """Valid groupings, the longest first, but for those that take a part of a usual one."""
    good = []
    for n in range(19, 12, -1):
        for i, c in enumerate(text):
            if not digit(c) or i and (digit(text[i - 1]) or text[i - 1] == "+"):
                continue
            for sep in " -":
                j, k = i + 1, 1
                while k < n and j < len(text) and (digit(text[j]) or text[j] == sep and j + 1 < len(text) and digit(text[j + 1])):
                    j += 1 + (text[j] == sep)
                    k += 1
                if k == n and not (j < len(text) and digit(text[j])):
                    if luhn("".join(filter(digit, text[i:j]))) and text[i:j] not in good:
                        good.append(text[i:j])
                    break
    usual = [c for c in good if re.fullmatch(r"\d{13,19}|\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", c, ASCII)]
    head = lambda u: re.match(r"\d+[ -]?", u, ASCII)[0]
    return [c for c in good if c in usual or not any(head(u) in c and u not in c for u in usual)]


def ibans(text):
    out = []
    for i in range(len(text) - 14):
        n = SIZES.get(text[i : i + 2])
        if not n or not (digit(text[i + 2]) and digit(text[i + 3])) or i and alnum(text[i - 1]):
            continue
        j, k = i + 4, 4
        while k < n and j < len(text):
            j += text[j] == " "
            if j >= len(text) or not (digit(text[j]) or "A" <= text[j] <= "Z"):
                break
            j, k = j + 1, k + 1
        compact = text[i:j].replace(" ", "")
        if k == n and not (j < len(text) and alnum(text[j])) and mod97(compact[4:] + compact[:4]) == 1:
            out.append(text[i:j])
    return out


def address(text, i):
    found = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}", ASCII).match(text, i)
    for end in range(found.end(), i, -1) if found else ():
        octets = text[i:end].split(".")
        if len(octets) == 4 and all(o and str(int(o)) == o and int(o) < 256 for o in octets):
            if not digit(text[end : end + 1] or " ") and not re.match(r"\.\d", text[end:], ASCII):
                return text[i:end]
    return None


def spans(text):
    """``(kind, start, end)`` by position; at one position in the order of kinds."""
    dates = [m[1] for m in re.finditer(r"(?=(\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}))", text, ASCII) if as_date(m[1])]
    lists = {"iban": ibans(text), "date": dates, "card": cards(text)}
    marks = sorted({m.start() for m in re.finditer(r"[0-9+(]|[A-Z](?=[A-Z][0-9])", text)} | {i for m in re.finditer("@", text) for i in range(max(0, m.start() - 64), m.start())})
    out, at = [], 0
    for i in marks:
        if i < at:
            continue
        before = text[i - 1] if i else " "

        def of(kind, i=i, before=before):
            rest = lambda v: text[i + len(v) : i + len(v) + 1] or " "
            if kind == "email":
                return (m := MAIL.match(text, i)) and m[0]
            if kind == "ip":
                return None if digit(before) or before == "." else address(text, i)
            if kind == "ssn":
                found = re.compile(r"(\d{3})-(\d\d)-(\d{4})(?!\d|-\d)", ASCII).match(text, i)
                ok = found and found[1] not in ("000", "666") and found[1][0] != "9" and found[2] != "00" and found[3] != "0000"
                return found[0] if ok and not digit(before) and before != "-" else None
            if kind == "phone":
                bad = (digit(before) or before == "+", digit(before), digit(before) or before == "-")
                return next((m[0] for p, no in zip(PHONES, bad) if not no and (m := p.match(text, i))), None)
            side = {"iban": lambda v: not alnum(before) and not alnum(rest(v)), "date": lambda v: not digit(before) and not digit(rest(v)), "card": lambda v: not digit(before) and before != "+" and not digit(rest(v))}[kind]
            return next((v for v in lists[kind] if text.startswith(v, i) and side(v)), None)

        for kind in ("email", "iban", "date", "ip", "ssn", "phone", "card"):
            if value := of(kind):
                out.append((kind, i, i + len(value)))
                at = i + len(value)
                break
    return out


# --- pseudonyms -------------------------------------------------------------------------------------------------------


def feistel(x, left, right, key, tweak):
    a, b = divmod(x, right)
    for i in range(8):
        mix = lambda half, size: int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16) % size  # noqa: E731, B023
        a, b = ((a + mix(b, left)) % left, b) if i % 2 == 0 else (a, (b + mix(a, right)) % right)
    return a * right + b


def permuted(digits, key, kind):
    def part(s, tweak):
        low = (len(s) + 1) // 2
        return str(feistel(int(s), 10 ** (len(s) - low), 10**low, key, f"{kind}:{len(s)}:{tweak}")).zfill(len(s)) if s else ""

    return part(digits[:18], "") + part(digits[18:], digits[:18])


def refilled(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if digit(c) else c for c in shape)


def letters(text, key, kind):
    out = ""
    for i in range(0, len(text), 12):
        piece, before = text[i : i + 12], text[:i]
        shape = re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", piece))
        low = [c.lower() for c in piece if alnum(c) and not digit(c)]
        number = 0
        for c in low:
            number = number * 26 + ord(c) - 97
        half = (len(low) + 1) // 2
        x = feistel(number, 26 ** (len(low) - half), 26**half, key, f"{kind}:{before}/{shape}") if low else 0
        new = []
        for _ in low:
            x, c = divmod(x, 26)
            new.insert(0, chr(97 + c))
        own, numbers = iter(new), iter(permuted("".join(filter(digit, piece)), key, kind))
        out += "".join(next(numbers) if digit(c) else (next(own).upper() if c.isupper() else next(own)) if alnum(c) and not digit(c) else c for c in piece)
    return out


def pseudonym(kind, value, key):
    plain = "".join(filter(digit, value))
    if kind == "card":
        body = permuted(plain[:-1], key, "card")
        return refilled(value, next(body + c for c in "0123456789" if luhn(body + c)))
    if kind == "phone":
        k = len(re.match(r"(\+\d{1,3}(?=\D)|\+\d|)", value, ASCII)[0])
        return value[:k] + refilled(value[k:], permuted("".join(filter(digit, value[k:])), key, "phone"))
    if kind == "ssn":
        while True:
            plain = permuted(plain, key, "ssn")
            if plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000":
                return refilled(value, plain)
    if kind == "date":
        day, order = as_date(value)
        n = (day - date(1900, 1, 1)).days
        while True:
            n = feistel(n, 271, 271, key, "date")
            if n < 73049:
                break
        new = date(1900, 1, 1) + timedelta(n)
        return new.strftime({"ymd": "%Y-%m-%d", "dmy": "%d.%m.%Y", "mdy": "%m/%d/%Y"}[order])
    if kind == "ip":
        low, size, x = [], [], 0
        for o in value.split("."):
            low.append((0, 10, 100)[len(o) - 1])
            size.append((10, 90, 156)[len(o) - 1])
            x = x * size[-1] + int(o) - low[-1]
        x, out = feistel(x, size[0] * size[1], size[2] * size[3], key, "ip:" + ".".join(map(str, low))), []
        for s, b in zip(size[::-1], low[::-1]):
            x, o = divmod(x, s)
            out.insert(0, str(o + b))
        return ".".join(out)
    if kind == "iban":
        compact = value.replace(" ", "")
        tail = refilled(compact[4:], permuted("".join(filter(digit, compact[4:])), key, "iban"))
        own = iter(f"{compact[:2]}{98 - mod97(tail + compact[:2] + '00'):02d}{tail}")
        return "".join(c if c == " " else next(own) for c in value)
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    keep = "." * (len(labels) > 2) + ".".join(labels[-2:])
    head = domain[: len(domain) - len(keep)]
    return f"{letters(local, key, 'local')}@{letters(head, key, 'host') if head else ''}{keep}"


def replaced(text, key):
    found, out, at = spans(text), "", 0
    for kind, a, b in found:
        out += text[at:a] + pseudonym(kind, text[a:b], key)
        at = b
    return out + text[at:], found
