"""Hand-made pages for the markup rules, with the lines that the rules give for them."""

from __future__ import annotations

import datetime

TEMPLATES = {
    "Template:Note": "'''{{{1}}}''' by {{{2|nobody}}}.",
    "Template:Lower": "{{{1|{{lc:ABC}}}}} z",
    "Template:Deep": "{{{{{{p}}}}}}",
    "Template:Old": "#REDIRECT [[Template:Note]]",
    "Template:Only": "x<onlyinclude>kept</onlyinclude>y<noinclude>doc</noinclude>",
    "Template:Part": "a<noinclude>b</noinclude>c<includeonly>d</includeonly>e<noinclude>open",
    "Template:Clock": "{{CURRENTYEAR}}-{{CURRENTMONTH}}",
    "Template:Page": "{{PAGENAME}}!",
}
NOW = datetime.datetime(2020, 5, 17, 9, 30)

#: By operator: wiki text and the lines it gives.  The page's title is "Case".
CASES: dict[str, list[tuple[str, str]]] = {
    "c01_templates": [("{{Note|x}} end", "x by nobody. end"), ("{{note|x|y}}", "x by y."), ("{{unknown|x}}left", "left"), ("a {{b {{note|c}} tail", "a {{b c by nobody. tail")],
    "c02_tables": [("a\n{| class=x\n| b\n{| nested |}\n|}\nc", "a\nc"), ("a {| b\nc {| d |} e", "a {| b\nc e")],
    "c03_external_links": [("see [http://a.org/x the site] and [mailto:x@y.org mail]", "see the site and mail"), ("[http://a.org http://b.org/c.png]end", "end"), ("[nope x] [//a.org rest]", "[nope x] rest"), ("[IRC://a.org/b chat]", "chat")],
    "c04_internal_links": [("[[Rose|roses]] and [[tree]]s", "roses and trees"), ("a [[File:a.png|thumb|b [[c]]]]x [[w:x|y]] [[:Category:q]]z", "a x y z"), ("[[a [[b|c]] and [[d|e]]", "[[a c and e")],
    "c05_switches": [("a__NOTOC__b __INIT__ c__DISAMBIG__", "ab __INIT__ c")],
    "c06_entities": [("&lt;x&gt; &amp; &eacute; &#233; &zzz;", "<x> & é é &zzz;")],
    "c07_quotes": [("''it'' '''b''' '''''bi'''''", '"it" b bi'), ("open '''left", "open left")],
    "c08_comments_and_tags": [('a<!-- x\ny -->b<br/>c <b>d</b> <span class="q">e</span>', "abc d e")],
    "c09_discarded_elements": [("a<ref>b</ref>c <div>d<div>e</div>f</div>g", "ac g"), ("a <div>b <div>c</div> d", "a <div>b d")],
    "c10_second_unescape": [("a &amp;lt; b", "a < b")],
    "c11_formulas_and_code": [("x <math>a+b</math> y <code>z</code>", "x ***formula*** y ***codice***")],
    "c12_tidy": [("a  b\tc.....d ,, e ,. <<f>>", "a b c...d , e . «f»")],
    "c14_keep_links": [("[[Rose|roses]] [http://a.org/x site]", '<a href="Rose">roses</a> <a href="http%3A//a.org/x">site</a>')],
    "c15_compact": [
        ("==A==\n===B===\n===C===\ntext\n* one\n* two\nafter\nmore\n==D==\n==E==\n: no\n(gone)\n--\n line\n x\ny}\nw", "========,2,A.\n========,3,C.\ntext\n***LIST***. \n***LIST***. \nafter\nmore\n========,2,E.\n line\nw"),
        ("==A==\n* one\nx\nlost\n==B==\ny", "========,2,A.\n***LIST***. \nx\n========,2,B.\ny"),
    ],
    "c16_section_headers": [("==What is it?==\nx", "========,2,What is it?.\nx"), ("== A.B ==\nx\n==Empty==", "========,2,AB.\nx"), ("++Title++\nx", "Title.\nx")],
    "c17_html": [("==A==\n* one\n** two\nafter", "<h2>A</h2>\n<ul>\n<li>one</li>\n<ul>\n<li>two</li>\nafter\n</ul>\n</ul>")],
    "t01_nested_parameters": [("{{lower}}", "abc z"), ("{{lower|Q}}", "Q z"), ("{{deep|p=q|q=r}}", "r"), ("{{#if:|a|b}} {{{1|d}}} end", "b {{{1|d}}} end")],
    "t02_parameters": [("{{note|2=b|1=a}}", "a by b."), ("{{note| a | b }}", "a by b."), ("{{note|[[x|y]]}}", "y by nobody.")],
    "t03_magic_words": [("{{clock}} {{CURRENTDAY}}", "2020-05 17"), ("{{page}} {{FULLPAGENAME}} a{{!}}b", "Case! Case a|b")],
    "t04_conditions": [("{{#if:x|a|b}} {{#if:|a|b}}", "a b"), ("{{#ifeq:a|a|yes|no}} {{#ifeq:a|b|yes|no}}", "yes no"), ("{{#iferror:{{#expr:1/}}|bad|good}} {{#iferror:1|bad|good}}", "bad good"), ("{{#switch:b|a=1|b=2|#default=3}}{{#switch:z|a=1|#default=3}}{{#switch:a|a|b=2|c=3}}", "232")],
    "t05_arithmetic": [("{{#expr:1+2*3}} {{#expr:(1+2)*3}} {{#expr:7 mod 4}} {{#expr:2^3}}", "7 9 3 8")],
    "t06_letter_case": [("{{lc:ABC}} {{uc:abc}} {{lcfirst:ABC}} {{ucfirst:abc}} {{urlencode:a b}}", "abc ABC aBC Abc a+b")],
    "t07_unsupported": [("x{{#ifexist:A|b|c}}{{#time:Y}}y", "xy")],
    "t08_modules": [("{{#invoke:If empty|main||b}} {{#invoke:convert|convert|3|km}}", "b 3 km")],
    "t09_definitions": [("{{only}} {{part}}", "kept acde")],
    "t10_redirects": [("{{old|x|y}}", "x by y.")],
    "t11_titles": [("{{Template:Note|x}} {{ note |x}}{{:Note|x}}", "x by nobody. x by nobody."), ("{{template:_note|x}}", "x by nobody.")],
}
