"""Plain Python versions of the stated base rules, for comparison."""

import hashlib
import re

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            )
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def pii_hash(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
