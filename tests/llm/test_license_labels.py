"""License labels that are easily taken for each other."""

import pytest

from noteflare.llm import license_scan

GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public "
       "License as published by the Free Software Foundation, either version 3")
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
NOTICES = [
    ("Licensed under CC BY 4.0", {"cc-by"}), ("Licensed under CC BY-SA 4.0", {"cc-by-sa"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
    ("Licensed under the GNU General Public License, version 2.0", {"gpl"}),
    ("Licensed under the Mozilla Public License, version 2.0", {"mpl"}),
    ("Licensed under the Apache License, Version 2.0", {"apache"}),
    (CC.format(""), {"cc-by"}), (CC.format("-NonCommercial-ShareAlike"), {"cc-by-nc-sa"}), (CC.format("-ShareAlike"), {"cc-by-sa"}),
    (GPL.format(""), {"gpl"}), (GPL.format("Lesser "), {"lgpl"}), (GPL.format("Affero "), {"agpl"}),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
     "provided that the above\ncopyright notice and this permission notice appear in all copies.", {"isc"}),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying "
     "documentation covered by\nthis license (the Software) to use, reproduce, display, distribute,\nexecute, and transmit the "
     "Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished "
     "to\ndo so, all subject to the following", {"bsl"}),
    ("licensed under the terms of the version we like, by 4 or 0 people with a cc", set()),
    ("In the version 2.0 of the text, licensed under nothing, the license is not named.", set()),
]


@pytest.mark.parametrize("text,labels", NOTICES)
@pytest.mark.parametrize("before", [0, 300])
def test_label(text, labels, before):
    assert license_scan.Index({}).scan("word " * before + text + " more" * 200)[2] == labels


def test_two_notices_far_apart_keep_both():
    text = "Licensed under CC BY 4.0 " + "word " * 600 + "Licensed under CC BY-SA 4.0"
    assert license_scan.Index({}).scan(text)[2] == {"cc-by", "cc-by-sa"}


def test_columns_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "MIT License", "x", "y")], "doc_id long, text string, Labels string, SCORE string")
    out = license_scan.scan(df)
    assert [c for c in out.columns if c.lower() == "labels"] == ["labels"] and out.select("labels").first()[0] == "mit"
