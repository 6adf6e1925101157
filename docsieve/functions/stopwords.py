"""A short English stop list.

It is this package's own list of function words, not a copy of any other library's;
pass another list wherever a different one is wanted.
"""

# Fixed values, grouped by kind.
ENGLISH = tuple(
    """
    a an the this that these those such same other another each every any some all both
    either neither no none few many much more most less least several own only
    i me my myself we us our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their theirs themselves
    who whom whose which what
    be am is are was were been being have has had having do does did doing done
    will would shall should can could may might must cannot
    become became becomes becoming seem seemed seems
    and or but nor if because as until while although though than whether so
    of at by for with about against between into through during before after above below
    to from up down in out on off over under upon within without via per among across
    toward towards since except
    again further then once here there when where why how not very too just almost also
    even ever never always already yet still now often however therefore thus hence
    perhaps rather quite else
    """.split()
)
