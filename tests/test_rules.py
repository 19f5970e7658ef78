from collections import Counter

import pytest

from cipherlake.rules import tables as T

# name, rows, vulnerable, rows by class, rows by severity
CHECKSUMS = [
    ("PYTHON_MODULES", 19, 18, (13, 5, 0, 1), (7, 6, 5, 0, 1)),
    ("JS_MODULES", 19, 18, (14, 5, 0, 0), (5, 8, 5, 1, 0)),
    ("JS_LITERALS", 30, 27, (16, 12, 2, 0), (22, 1, 4, 3, 0)),
    ("JAVA_LITERALS", 51, 46, (28, 18, 5, 0), (32, 8, 5, 6, 0)),
    ("JAVA_IMPORTS", 9, 8, (7, 2, 0, 0), (2, 5, 1, 1, 0)),
    ("GO_IMPORTS", 32, 29, (19, 11, 1, 1), (12, 12, 5, 2, 1)),
    ("GO_TLS_SUITES", 5, 5, (5, 0, 0, 0), (5, 0, 0, 0, 0)),
    ("GO_CALLS", 16, 16, (9, 7, 0, 0), (15, 0, 1, 0, 0)),
    ("CSHARP_NAMESPACES", 7, 7, (6, 1, 0, 0), (0, 6, 1, 0, 0)),
    ("CSHARP_CLASSES", 36, 32, (14, 18, 4, 0), (18, 6, 8, 4, 0)),
    ("CSHARP_LITERALS", 15, 15, (6, 9, 0, 0), (11, 1, 3, 0, 0)),
]


@pytest.mark.parametrize("name,rows,vulnerable,classes,severities", CHECKSUMS)
def test_table_checksums(name, rows, vulnerable, classes, severities):
    rules = getattr(T, name)
    by_class, by_severity = Counter(r.vulnerability_class for r in rules), Counter(r.severity for r in rules)
    assert len(rules) == rows and sum(r.is_vulnerable for r in rules) == vulnerable
    assert tuple(by_class[c] for c in T.CLASSES.values()) == classes
    assert tuple(by_severity[s] for s in T.SEVERITIES) == severities
    assert [r.ord for r in rules] == list(range(1, rows + 1))


def test_sizes_of_other_tables():
    assert len(T.PYTHON_MEMBERS) == 27 and len(T.REDACTIONS) == 22 and len(T.JS_METHODS) == 25
    assert len(T.MANIFEST_RULES) == 14 and len(T.SOURCE_SKIP_DIRS) == 28 and len(T.MANIFEST_NAMES) == 20
    assert sum(map(len, T.KNOWN_FILES.values())) == 35 and len(T.KNOWN_FILES) == 10
