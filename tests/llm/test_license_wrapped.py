"""License notices that wrap over lines, found as the same notices on one line."""

import pytest

from noteflare.llm import license_scan

NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
           "the following conditions\nare met:",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           'documentation files (the "Software"), to deal\nin the Software without restriction, including',
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
}


@pytest.mark.parametrize("label", NOTICES)
@pytest.mark.parametrize("before", [0, 1, 60, 100, 127, 128, 250, 1000])
def test_wrapped_notice(label, before):
    notice = NOTICES[label]
    index = license_scan.Index({})
    for text in (notice, "\n# ".join(notice.split("\n")), "\n".join(notice.split())):
        _, _, found, score = index.scan("other\n" * before + text + "\nrest" * 300)
        assert found == {label} and score == 1.0


def test_words_too_far_apart():
    """Template words spread over more words than a block are no notice."""
    far = ("\n" + "x " * 12).join(NOTICES["mpl"].split())
    assert license_scan.Index({}).scan(far)[2] == set()


def test_wrapped_in_a_table(spark):
    df = spark.createDataFrame(list(NOTICES.items()), "doc_id string, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()} == {k: k for k in NOTICES}
