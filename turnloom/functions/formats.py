"""Chat prompts of the configured formats, as columns: plain pairs, pairs of services (sgd), and code."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code import code_prompt
from .prompting import CODE_FORMATS, message, state_text

#: What a turn's parts are called in a prompt, and what each turn is told.
TITLE = "\n**Example {} of Dialogue State Change Update Task:**\n"
BEFORE = "    **Previous Belief State (Before the Latest User Interaction):** \n        "
LATEST = "\n\n    **Latest Conversation Between System and User:** \n"
SYSTEM, USER = '        **System:** "', '        **User:** "'
INSTRUCTIONS = (
    "    **Instructions:**\n"
    "        - Based on the user's latest input, update the belief state by correctly identifying and filling in the relevant domain(s), slot(s) and value(s).\n"
    "        - Provide your output strictly in the Required Output Format below.\n\n"
    "    **Required Output Format:**\n"
    "        **Dialogue state change after Latest Conversation Between System and User:** \n"
    '            { "DOMAIN_1-SLOT_1": "VALUE_1", "DOMAIN_2-SLOT_2": "VALUE_2", ... }\n'
)
SERVICE_INSTRUCTIONS = (
    "    **Task Instructions:**\n"
    "    1. **Identify Service and Intent**: Match user input to the relevant service and intent.\n"
    "    2. **Extract Slots**: Fill required slots from the input; apply defaults as needed.\n"
    "    3. **Format Output**: Provide the updated dialogue state in JSON format:\n"
    "        ```json\n"
    '        { "DOMAIN-SLOT": "VALUE", ... }\n'
    "        ```\n"
)
GUIDELINES = "**Guidelines:**\n\n"
#: Service cards of a prompt at least.
CARDS = 4


def _turn(context: Column, sys: Column, usr: Column, instructions: str) -> Column:
    silent = F.coalesce(sys, F.lit("none")).isin("none", "")
    system = F.when(silent, "").otherwise(F.concat(F.lit(SYSTEM), sys, F.lit('"\n')))
    return F.concat(F.lit(BEFORE), state_text(context), F.lit(LATEST), system, F.lit(USER), F.coalesce(usr, F.lit("")), F.lit('"\n\n'), F.lit(instructions))


def _title(n: Column) -> Column:
    before, after = TITLE.split("{}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def pair_prompt(system: str, examples: Column, context: Column, sys: Column, usr: Column, instructions: str = INSTRUCTIONS, every_turn: bool = True, last: bool = True, guidelines: Column | None = None) -> Column:
    """Numbered examples (an array of context, sys, usr, delta; worst first), then the query turn. Examples are told the
    ``instructions`` if ``every_turn``, the query turn if ``last``. ``guidelines`` go before the first message after the
    system's."""
    told = instructions if every_turn else ""

    def shot(x: Column, i: Column) -> Column:
        asked = F.concat(_title(i + 1), _turn(x["context"], x["sys"], x["usr"], told))
        return F.array(message("user", asked), message("assistant", F.concat(F.lit("            "), state_text(x["delta"]), F.lit("\n"))))

    query = F.concat(_title(F.size(examples) + 1), _turn(context, sys, usr, instructions if last else ""))
    every = F.concat(F.flatten(F.transform(examples, shot)), F.array(message("user", query)))
    if guidelines is not None:
        first = lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(GUIDELINES), guidelines, m["content"])).otherwise(m["content"]).alias("content"))
        every = F.transform(every, first)
    return F.concat(F.array(message("system", F.lit(system))), every)


def drawn_cards(cards: dict[str, str]) -> list[str]:
    """Names of the cards that fill up a prompt: the one at place n is drawn by the seed n."""
    return [random.Random(n).choice(list(cards)) for n in range(CARDS)]


def service_cards(domains: Column, cards: dict[str, str]) -> Column:
    """The numbered cards of a turn's services (those that have one), filled up to CARDS with ``drawn_cards``, among
    which may be one that is there already."""
    names = list(cards)
    known = F.create_map(*(F.lit(x) for kv in cards.items() for x in kv))
    own = F.filter(domains, lambda d: F.array_contains(F.array(*map(F.lit, names)), d))
    more = F.slice(F.array(*map(F.lit, drawn_cards(cards))), F.least(F.size(own), F.lit(CARDS)) + 1, CARDS)
    listed = F.transform(F.concat(own, more), lambda d, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.element_at(known, d)))
    return F.array_join(listed, "")


def prompt(prompt_format: str, system: str, examples: Column, context: Column, sys: Column, usr: Column, domains: Column | None = None, guidelines: str = "", cards: dict[str, str] | None = None, every_turn: bool = True) -> Column:
    """A prompt by its format's name. ``guidelines`` (pairs, code) and ``cards`` (services, which need ``domains``) are texts
    that a run is configured with; without them a prompt has none."""
    if prompt_format in CODE_FORMATS:
        return code_prompt(system, guidelines, examples, context, sys, usr, reverse=prompt_format.endswith("NULL"))
    if "sgd" in prompt_format.lower():
        if cards and domains is None:
            raise ValueError(f"{prompt_format}: service cards need the turn's domains")
        return pair_prompt(system, examples, context, sys, usr, SERVICE_INSTRUCTIONS, every_turn, True, service_cards(domains, cards) if cards else None)
    return pair_prompt(system, examples, context, sys, usr, INSTRUCTIONS, every_turn, every_turn, F.lit(guidelines) if guidelines else None)
