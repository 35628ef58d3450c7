"""Real licence texts, wrapped as they are in files, against the rules by hand."""

import textwrap

from laborlens.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
{0} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD_IDS = ["bsd_grant", "bsd_source", "bsd_binary"]
APACHE_IDS = ["apache2", "apache_use", "apache_copy", "apache_asis"]


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.split("\n"))


def unwrapped(text):
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def scan(make_docs, texts):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(texts)).collect()}
    return [got[i] for i in range(len(texts))]


def test_whole_licence_texts(make_docs):
    forms = [lambda t: t, unwrapped, lambda t: commented(t, " *"), lambda t: commented(t, "#"), lambda t: t.replace("\n", "\r\n"),
             lambda t: "\n\n".join(textwrap.fill(p, 30) for p in t.split("\n\n"))]
    three, two = BSD.format("1.", "2.") + ENDORSE.format("3."), BSD.format("*", "*")
    want = [(MIT, ["mit", "mit_grant", "mit_notice", "mit_asis"], "MIT-text"), (three, [*BSD_IDS, "bsd_endorse"], "BSD-3-Clause"),
            (BSD.format("(1)", "b)"), BSD_IDS, "BSD-2-Clause"), (two, BSD_IDS, "BSD-2-Clause"), (APACHE, APACHE_IDS, "Apache-2.0-notice"),
            (GPL, ["gpl3plus", "gpl_hope"], "GPL-3.0-or-later")]
    rows = scan(make_docs, [form(text) for text, _, _ in want for form in forms])
    for i, r in enumerate(rows):
        _, ids, name = want[i // len(forms)]
        assert (r["sentence_ids"], r["license"]) == (ids, name), (i // len(forms), i % len(forms))


def test_lead_ins_and_line_ends(make_docs):
    texts = ["This file is licensed under the MIT License.", "x\nThis project is released under the terms\nof the MIT license", "words\nall rights\nreserved\nwords",
             "all rights\n\nreserved", "all rights. reserved", "he has all rights\nreserved", "all rights\nreserved seats", "The MIT License (MIT)\n\nCopyright",
             "Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/", "heading\nAll rights reserved\nAll rights reserved"]
    got = [r["sentence_ids"] for r in scan(make_docs, texts)]
    assert got == [["mit"], ["mit"], ["reserved"], [], [], [], [], ["mit"], ["apache2"], ["reserved", "reserved"]]
