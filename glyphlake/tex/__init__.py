"""TeX mathematics: commands, inspection, translation to and from Unicode, renderer compatibility, layout."""
