"""Edit sessions: nested operations, commit and rollback, over immutable versions of tables.

The outermost operation remembers every registered table; aborting restores what the last outermost operation remembered.
Nested operations are not savepoints. Aborting without any operation keeps the edits in memory and writes nothing. A
commit needs a started session whose operations have all stopped, writes all tables that were changed at once, and lets go of
the working versions, so that later edits begin with the tables as written.
"""

from __future__ import annotations

from collections.abc import Callable

from parcela.operators.table import EditError, FeatureTable


class EditSession:
    """Working versions of the tables of a workspace (anything with open() and commit())."""

    def __init__(self, workspace) -> None:
        self.workspace, self.started, self.depth = workspace, False, 0
        self.working: dict[str, FeatureTable] = {}
        self.remembered: dict[str, FeatureTable] = {}
        self.opened: dict[str, FeatureTable] = {}

    def start(self) -> None:
        self.started = True

    @property
    def is_being_edited(self) -> bool:
        return self.started

    @property
    def operation_depth(self) -> int:
        return self.depth

    def start_operation(self) -> None:
        if not self.started:
            raise EditError("the session has not started")
        if self.depth == 0:
            self.remembered = dict(self.working)
        self.depth += 1

    def stop_operation(self) -> None:
        if self.depth == 0:
            raise EditError("no operation has started")
        self.depth -= 1

    def begin_transaction(self) -> None:
        self.start()
        self.start_operation()

    def register(self, table: FeatureTable) -> FeatureTable:
        """Takes a table into the session; one that comes during an operation is remembered as it is now."""
        self.working[table.name] = table
        if self.depth:
            self.remembered.setdefault(table.name, table)
        return table

    def open(self, name: str) -> FeatureTable:
        if name not in self.working:
            self.opened[name] = self.register(self.workspace.open(name))
        return self.working[name]

    def edit(self, name: str, change: Callable[[FeatureTable], FeatureTable]) -> FeatureTable:
        """Puts what the change makes of a table in its place."""
        self.working[name] = change(self.open(name))
        return self.working[name]

    def commit(self) -> None:
        if not self.started:
            raise EditError("the session has not started")
        if self.depth:
            raise EditError(f"{self.depth} operations have not stopped")
        changed = {name: table for name, table in self.working.items() if table is not self.opened.get(name)}
        if changed:
            self.workspace.commit(changed)
        self.working, self.opened = {}, {}
        self.ended()

    def abort(self) -> None:
        self.working.update(self.remembered)
        self.ended()

    def ended(self) -> None:
        self.remembered, self.started, self.depth = {}, False, 0
