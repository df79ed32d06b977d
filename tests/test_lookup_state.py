"""How a key's entries lie in the state of the feature lookup."""

from touchflow.streaming.lookups import _Lookup


class Elements(list):
    """A list state in memory."""

    def get(self):
        return iter(self)

    def appendList(self, more):
        self.extend(more)

    def put(self, new):
        self[:] = new


def test_entries_share_elements_and_come_back_in_order():
    state, entries = Elements(), [(at, ["x", at]) for at in range(2500)]
    _Lookup._keep(state, [], entries, entries)
    assert len(state) == 3 and _Lookup._entries(state) == entries
    _Lookup._keep(state, entries, [(9, ["y", 9])], [*entries, (9, ["y", 9])])
    assert len(state) == 4 and len(_Lookup._entries(state)) == 2501
    _Lookup._keep(state, entries, [], entries[:7])
    assert _Lookup._entries(state) == entries[:7]
    _Lookup._keep(state, entries[:7], [], [])
    assert state == []
    _Lookup._keep(state, [], [(1, ["z", 1])], [])  # answered at once
    assert state == []
