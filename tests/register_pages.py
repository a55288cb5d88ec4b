"""A register for tests: pages of companies, and failures on the way."""

import os

CALLS = "CALLS_OF_REGISTER"


def company(i, place, code="62012", status="active"):
    return {"company_number": f"{place}-{i}", "company_name": f"Firm {i}", "company_status": status, "sic_codes": [code, 7], "registered_office_address": {"line": f"{i} High St", "locality": place, "postal_code": None}}


def pages(codes, place, size, start):
    with open(os.environ[CALLS], "a") as f:
        f.write(f"{place} {start} {size}\n")
    rows = [company(i, place, codes[0]) for i in range({"York": 25, "Leeds": 10, "Hull": 0}.get(place, 30))]
    if place == "York":
        rows[3] |= {"company_number": None}
        rows[4] |= {"company_status": "dissolved"}
        rows[5] |= {"sic_codes": ["82200"]}
        rows[6] |= {"company_number": "York-0"}
        rows[7] |= {"company_status": None, "sic_codes": None, "registered_office_address": None}
    return rows[start : start + size]


def endless(codes, place, size, start):
    return [company(start + i, place) for i in range(size)]


def flaky(codes, place, size, start):
    path = os.environ[CALLS]
    n = sum(1 for _ in open(path)) if os.path.exists(path) else 0
    with open(path, "a") as f:
        f.write("x\n")
    if n < 2:
        raise OSError("busy")
    return [company(start, place)]
