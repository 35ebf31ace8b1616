"""The labelled table that the random field of ``personal`` learns from.

A line is a context with one blank; a form fills the blank.  ``table`` pairs contexts and forms
by a rule: every context meets some forms of its kind and every form meets several contexts.
In a form ``#`` stands for a digit, ``~`` for a lower-case hexadecimal digit, ``^`` for a
capital or digit and ``*`` for any letter or digit; which one is drawn from the line's number.
"""

from __future__ import annotations

import re
import zlib

PAIRINGS = 6  # forms that each context meets

# Forms and contexts by kind.
FORMS = {
    "email": """
anna.berg#@mail.example.com
j_lee##@site.example.org
sales@shop#.example.net
x#@mail#.example.com
kurt.w@post.example.de
info+news@example.co.uk
m-######@example.info
""",
    "ip": """
1#.2#.3#.4#
192.168.1#.#
85.21#.13#.11#
172.16.25#.1
10.0.0.#
""",
    "card": """
4556 #### #### ####
4556-####-####-####
4556############
5500 #### #### ####
3782 ###### #####
6011-####-####-####
""",
    "phone": """
+1 (415) 555-01##
+49 30 9018##
+44 20 7946 0###
(415) 555-01##
(212) 555-01##
415-555-01##
415.555.01##
415 555 01##
0171 23456##
030 9018 2###
0171-23456##
01 42 68 53 ##
020 7946 0###
1-800-555-0###
""",
    "secret": """
"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"
~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~
"~~~~~~~~~~~~~~~~"
~~~~~~~~~~~~~~~~~~~~
AKIA^^^^^^^^^^^^^^^^
'AKIA^^^^^^^^^^^^^^^^'
sk_live_************************
ghp_************************************
"*****#*************#****#***"
Hunter#isgreat##
Tr0ub4dor##horse
""",
}
CONTEXTS = {
    "email": """
write to {} for more
contact {} or the office
mail {} before noon
{} was the sender
und dann {} geschrieben
his address is {} and hers
questions go to {}
escribe a {} para saber
""",
    "ip": """
the host {} did not answer
from {} to the server
adresse {} du serveur
{} is down
the server at {} restarted twice
blocked {} after 20 tries
ping {} from the office
""",
    "card": """
paid with {} last week
card {} was charged
number {} and name
la tarjeta {} del cliente
die Karte {} ist gesperrt
visa {} expires in May
{} was used twice
y {} para la compra
they wrote {} on the back
mastercard: {} until autumn
""",
    "phone": """
call {} today
call me at {} after six
tel {} abends
tel: {} or come by
phone {} during the day
ring {} after six
or {} in the evening
his number (home) is {} and the
fax {} is out of order
mobile {} at any time
reach us on {} from 9 to 5
Telefon: {} im Haus
mon numéro est le {} le soir
llama al {} para pedir
text {} if late
rufen Sie {} an
bitte {} anrufen
und {} am Morgen
as well as {} on weekdays
at {} between lunch and dinner
{} is where she can be found
home {} or work
or try {} at night
appelez le {} avant midi
cell: {} most days
número {} por la tarde
his is {} and hers
leave a message on {} please
her line is {} at the moment
""",
    "secret": """
token = {} in the file
token = {} was used
token: {} is valid
the key = {} must stay hidden
api_key={} here
api-key: {} for the service
password={} is old
password: {} was sent
una password={} en el texto
secret: {} stored
AWS_SECRET_ACCESS_KEY={} in the shell
aws key {} was found
my password is {} at home
Authorization: Bearer {} is sent
access_token={} expires
client_secret = {} of the app
""",
}
# Numbers that are nobody's: contexts whose blank takes one of the forms after the bar.
OTHERS = """
id={} of the row | ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ / #### / ~~~~~~~~~~~~~~~~
commit {} fixes the build | ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ / ~~~~~~~
sha1 {} of the file | ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ / ~~~~~~~~~~~~~~~~
checksum: {} matches | ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ / ~~~~~~~~
uuid {} of the device | ~~~~~~~~-~~~~-4~~~-8~~~-~~~~~~~~~~~~
order {} came at 5pm | ## / 4######## / A-######
order number {} was shipped | 4######## / 1##-#######-#######
isbn {} of 2005 | 978-3-16-148410-# / 97831614841## / 0-306-40615-#
part no. {} is sold out | 45-####-## / AB####### / 7#######
in {} they moved to the north | 19## / 18## and 19## / 20##
from {} and again | 1914 to 1918 / 1939 to 1945 / 19## 19## 20##
the years {} were dry | 1976 1983 1995 2003 / 20## 20## 20## / 2003, 2011 and 2018 / 1914 1918 1939 1945 2005
on {} and later | 12 May 2003 / 2024-05-17 / 17.05.2024 / 05/17/2024
version {} was released | 2.10.3 / 1.#.#.## / 3.#
the price is {} or less | 1,299.00 euro / 12.50 / $4,000,000
see pages {} of the book | 12-18 and 43 / 1##-1## / 212, 230 and 415
at {} on the 4th day | 10:30 / 10:30:15 / 22.15
about {} people live there | 20,000 / 1 250 000 / 3 415 000 / 555
population of {} in all | 2 345 678 / 1,000,000 / 12 400 000
x = {} and y = 17 in the example | 42 / 0.####### / -#.##
room {} on the floor | 217 / 3.14 / B#2
chapter 4 section {} says | 2.1 / 4.1.#.# / 12
a score of {} after 90 minutes | 3-2 / 21-19 / 6-4 6-3 7-5
GNU General Public License, version {} | 3. / 2.1
Apache License, Version {} | 2.0. / 1.1
Licensed under CC {} | BY-NC 4.0. / BY-SA 3.0
rows {} of the table | 1 2 3 4 5 6 7 8 9 10 / 11 12 13 14 15 16 / 100 200 300 400 500
item {} pieces | 15: 30 / 16: 45 / 1: 1000
code {} means success | 200 / 0x~~~~ / 40#
width={} in the page | 300 height=200 / 1024 / 100%
the colour {} of the title | ~~~~~~ / rgb(12, 40, 99)
it has {} in memory | 16 bits and 32 words / 4096 bytes
{} north of the town | 10 km / 48 degrees 12 minutes / 3.5 miles
at {} on the map | 48.2082, 16.3738 / 51.507351 -0.127758 / 40 26 46 N
meet @ the corner at {} | 7 / 10
{} in brackets | (1998) and (2001) / (12) (13) (14)
rated {} by users | 4.5/5 / 8 of 10
model {} is new | XJ-#### / iPhone15 / GT3000 / A380-800
a key = {} in the map | 12 / name / value1
the token {} of the list | count / 15 / item2
password = {} is missing | none / null / 8 characters
case {} before the court | 2:15-cv-0#### / 12-3##
flight {} to Rome | LH#### / AZ 16##
data {} follow | 3.1 4.1 5.9 2.6 / 0.12 0.55 0.71 / 120 415 212 555 99
a = {} in the proof | b and c = d / 2 b + 3 c
the number {} is prime | 104729 / 7919 / 2147483647
grid {} of cells | 10 x 10 / 1024x768
"""

_DRAWN = {
    "#": "0123456789",
    "~": "0123456789abcdef",
    "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "*": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
}
_BLANK = re.compile(r"[#~^*]")


def _lines(block: str) -> list[str]:
    return block.strip("\n").split("\n")


def filled(form: str, number: int) -> str:
    """The form with its stand-ins drawn by a hash of the number and the place."""
    return _BLANK.sub(lambda m: _DRAWN[m[0]][zlib.crc32(f"{number}:{m.start()}".encode()) % len(_DRAWN[m[0]])], form)


def table(kept=lambda context: True) -> list[tuple[str, str | None, int, int]]:
    """Lines as (text, kind or None, start, end of the value), of the contexts that are kept.

    Context i meets the forms i, i+1, ... of its kind, PAIRINGS in all (each form once if there
    are fewer); a blank of the other lines takes each of its own forms twice.
    """
    rows = []

    def add(context, form, kind):
        value = filled(form, len(rows))
        start = context.index("{}")
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        rows.append((context.replace("{}", value), kind, start + quoted, start + len(value) - quoted))

    for kind, block in CONTEXTS.items():
        forms = _lines(FORMS[kind])
        for i, context in enumerate(_lines(block)):
            if kept(context):
                for j in range(min(PAIRINGS, len(forms))):
                    add(context, forms[(i + j) % len(forms)], kind)
    for line in _lines(OTHERS):
        context, forms = line.split(" | ")
        if kept(context):
            for form in forms.split(" / ") * 2:
                add(context, form, None)
    return rows
