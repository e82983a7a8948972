"""Finite-state machines over the ordered rows of a key, run in parallel.

A machine has few states, so what a stretch of rows does to it is a small map from the state that enters to the state
that leaves, and maps of neighbouring stretches compose. A key is cut into chunks of time; each chunk becomes its map in a
task of its own, the maps are composed along the key (one row a chunk), and a second pass runs each chunk from the state that
enters it. No series has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """`step[letter][state]` is the next state; `enters[letter][state]` says that the row begins a new age. State 0 is the first."""

    states: list
    step: np.ndarray = field(repr=False)
    enters: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, first: Hashable, letters: int, rule: Callable[[Hashable, int], tuple[Hashable, bool]]) -> Machine:
        """All states that `rule(state, letter) -> (next, enters)` reaches from `first`."""
        states, at, table = [first], {first: 0}, []
        for state in states:  # grows while it is walked through
            row = [rule(state, letter) for letter in range(letters)]
            for reached, _ in row:
                if reached not in at:
                    at[reached] = len(states)
                    states.append(reached)
            table.append([(at[reached], enters) for reached, enters in row])
        return cls(states, np.array([[n for n, _ in row] for row in table]).T, np.array([[e for _, e in row] for row in table]).T)

    def effect(self, letters: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stretch, for each entering state: the state that leaves, its age since the stretch began or since it was entered, and which."""
        state, age, entered = np.arange(len(self.states)), np.zeros(len(self.states), np.int64), np.zeros(len(self.states), bool)
        for letter in letters:
            new = self.enters[letter][state]
            age = np.where(new, 1, age + 1)
            entered |= new
            state = self.step[letter][state]
        return state, age, entered


def run(df: DataFrame, machine: Machine, letter: Column, key: str, order: list[str], width: int) -> DataFrame:
    """`df` with `before` and `after` (numbers of states), `entered` and `age` (rows since the state was entered, itself counted).

    `order[0]` is a time in the unit of `width`; the others break its ties. A row whose letter is null is passed over:
    it leaves state and age as they are. A null key is a key of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    held = df.withColumns({"__letter": letter.cast("int"), "__chunk": F.floor(F.col(order[0]) / width)})
    head = f"`{key}` {kinds[key]}, __chunk long"

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        letters = pdf.sort_values(order)["__letter"].dropna().astype(int).tolist()
        state, age, entered = machine.effect(letters)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "__chunk": [pdf["__chunk"].iloc[0]], "to": [state.tolist()], "age": [age.tolist()], "entered": [entered.tolist()]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        state, age, states, ages = 0, 0, [], []
        pdf = pdf.sort_values("__chunk")
        for to, grown, entered in zip(pdf["to"], pdf["age"], pdf["entered"]):
            states.append(state)
            ages.append(age)
            state, age = int(to[state]), int(grown[state]) + (0 if entered[state] else age)
        return pdf[[key, "__chunk"]].assign(__state=states, __age=ages)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, age, out = int(pdf["__state"].iloc[0]), int(pdf["__age"].iloc[0]), []
        for x in pdf["__letter"]:
            before, new = state, False
            if x == x and x is not None:
                new = bool(machine.enters[int(x)][state])
                state, age = int(machine.step[int(x)][state]), 1 if new else age + 1
            out.append((before, state, new, age))
        before, after, entered, ages = zip(*out)
        return pdf[list(kinds)].assign(before=before, after=after, entered=entered, age=ages)

    effects = held.select(key, "__chunk", *dict.fromkeys(order), "__letter").groupBy(key, "__chunk").applyInPandas(effect, f"{head}, to array<int>, age array<long>, entered array<boolean>")
    entering = effects.groupBy(key).applyInPandas(enter, f"{head}, __state int, __age long").withColumnsRenamed({key: "__key", "__chunk": "__at"})
    joined = held.join(entering, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__at"))).drop("__key", "__at")
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", before int, after int, entered boolean, age long"
    return joined.groupBy(key, "__chunk").applyInPandas(walk, schema)


def named(number: Column, names: list[str]) -> Column:
    """The name of a state's number."""
    return F.element_at(F.array(*map(F.lit, names)), number + 1)
