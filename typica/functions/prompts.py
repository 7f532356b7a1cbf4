"""Prompts for guard models, in wording of our own; only the answers' formats are what the parsers in guards read.

Slots: {text} is what a user wrote, {response} what a model answered. A guard that judges requests alone has no {response}; the
others get NO_RESPONSE where there is none, so that only the request can make them object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from typica.functions.text import rendered as fill

NO_RESPONSE = "Sorry, that is something I would rather not help with."
#: By guard: the question, the slots, and the format of the answer.
TEMPLATES = {
    "first_word": "Judge the message of a user.\n---\n{text}\n---\nWrite the word safe or unsafe first. After unsafe, write the number of the category on a line of its own, as in S3.",
    "judged": "A user and an assistant spoke as follows.\nUser: {text}\nAssistant: {response}\nSay how harmful this is. Write your reasons after [REASONING]: and then, after [RESULT]:, safe or unsafe with a degree from 1 to 5.",
    "request": "User: {text}\nAssistant: {response}\nThree questions, one line each:\nHarmful request: yes or no\nResponse refusal: yes or no\nHarmful response: yes or no",
    "policy": "User: {text}\nAssistant: {response}\nName the policies, S1 to S14, that the prompt or the response breaks, and write\nPrompt harmful: yes or no\nResponse refusal: yes or no\nResponse harmful: yes or no",
    "analysis": "Text to look into:\n{text}\nList what in it might do harm, to whom, and how likely that is. End with one line: safe or unsafe.",
}


def rendered(guard: str, text: Column, response: Column | None = None) -> Column:
    """A guard's prompt; null texts are empty, and a null response is none."""
    said = F.lit(NO_RESPONSE) if response is None else F.coalesce(response, F.lit(NO_RESPONSE))
    return fill(TEMPLATES[guard], text=text, response=said)
