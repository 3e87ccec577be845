"""Parameters shared by the registered queries and their SQL."""

MIN_DATE = 19980101
OPERATORS = ["OPERATOR 1", "OPERATOR 4", "OPERATOR 7"]
OPERATOR_IDS = [1, 4, 7]
PHRASES = ["Atmosphere"]
ALLOWED = ["the", "was", "be", "not"]
TWO_WORDS = "Price or Value"
LABEL, MONTHS = "Feb-99", 12
START, END = 19980228, 19990228
# A window nobody has summarised: March 1999 to February 2000.
NEW_LABEL, NEW_START, NEW_END = "Feb-00", 19990228, 20000229
LIST_WIDTH = 1000
# The stored phrases, and others, some of several words.
STORED_PHRASES = ["Price or Value", "Atmosphere", "Food", "Drink", "Staff or Service", "Portion Size"]
SOME_PHRASES = ["atmosphere", "Price  or value", "staff was great", "back table", "food wasn't", "We'll be back", "slow", "was slow back"]
MANY_PHRASES = STORED_PHRASES + [
    " ".join(part for part in (noun, verb, word, more) if part)
    for noun in ("staff", "food", "price")
    for verb in ("was", "wasn't")
    for word in ("great", "friendly", "cold", "terrible", "lovely", "fine", "slow", "loud")
    for more in ("", "back", "table", "we'll be back")
]
