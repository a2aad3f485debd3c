"""Tables of the SMILES text descriptors: what is counted under which name."""

from __future__ import annotations

# Literals and patterns, in the order of the families.

#: Occurrences of any of the letters or literals, not overlapping.
COUNTS: dict[str, tuple[str, ...]] = {
    "SmilesCarbonCount": (r"C", r"c",),
    "SmilesNitrogenCount": (r"N", r"n",),
    "SmilesOxygenCount": (r"O", r"o",),
    "SmilesSulfurCount": (r"S", r"s",),
    "SmilesPhosphorusCount": (r"P", r"p",),
    "SmilesBoronCount": (r"B",),
    "SmilesFluorineCount": (r"F",),
    "SmilesChlorineCount": (r"Cl",),
    "SmilesBromineCount": (r"Br",),
    "SmilesIodineCount": (r"I",),
    "SmilesAromaticCarbonCount": (r"c",),
    "SmilesAromaticNitrogenCount": (r"n",),
    "SmilesAromaticOxygenCount": (r"o",),
    "SmilesAromaticSulfurCount": (r"s",),
    "SmilesSingleBondCount": (r"-",),
    "SmilesDoubleBondCount": (r"=",),
    "SmilesBranchOpenCount": (r"(",),
    "SmilesBranchCloseCount": (r")",),
    "SmilesBracketAtomCount": (r"[",),
    "SmilesChiralCenterCount": (r"@",),
    "SmilesPositiveChargeCount": (r"+",),
    "SmilesNegativeChargeCount": (r"-",),
    "SmilesStereoForwardCount": (r"/",),
    "SmilesStereoBackwardCount": ('\\',),
    "SmilesDotCount": (r".",),
    "SmilesAliphaticChainCount": (r"CCC",),
}

#: Occurrences that may overlap.
OVERLAPS: dict[str, tuple[str, ...]] = {
    "SmilesConjugatedSystemCount": (r"c=c-c=c", r"C=C-C=C", r"C=C-C=O",),
    "SmilesCyclopropylCount": (r"C1CC1",),
    "SmilesCyclobutylCount": (r"C1CCC1",),
    "SmilesCyclopentylCount": (r"C1CCCC1",),
    "SmilesCyclohexylCount": (r"C1CCCCC1",),
    "SmilesDimethylCount": (r"C(C)(C)",),
    "SmilesDoubleBondRingJunctionCount": (r"C=C1",),
    "SmilesEsterCount": (r"C(=O)O", r"OC(=O)",),
}

#: Matches of a pattern; the longest alternative stands first where it matters.
PATTERNS: dict[str, str] = {
    "SmilesThiolCount": r"S[H]|\[SH\]|\[S;H1\]|\[SH-\]|\[S-\]|S\(H\)",
    "SmilesThioetherCount": r"CSC|\[CH2\]S\[CH3\]|\[CH2\]S\[CH2\]|S\(C\)C",
    "SmilesCarbonylHeteroatomCount": r"C\(=O\)[NOS]",
    "SmilesAromaticCarbonHeteroatomCount": r"c[nospb]|[nospb]c",
    "SmilesCarbonPhosphorusBondCount": r"CP|PC|\[C\]P|C\[P\]",
    "SmilesCarboxylateCount": r"C\(=O\)\[O-\]",
    "SmilesBranchedAmideCount": r"C\(=O\)N\([^)]*C[^)]*\)",
    "SmilesHeteroatomSequenceCount": r"[CNO][CNO]|[CNSO][CNSO]|[CNP][CNP]|[CNOFPS][CNOFPS]",
    "SmilesTrifluoromethylCount": r"CF3|C\(F\)\(F\)F|\[CF3\]",
    "SmilesGuanidineBasicCount": r"N=C\(N\)N|N=C\(\[NH2\]\)\[NH2\]",
    "SmilesImidazoliumCount": r"\[n[H]?\+\]",
    "SmilesPyridiniumCount": r"\[n\+\]",
    "SmilesQuaternaryAmmoniumBasicCount": r"\[N\+\]\([^H)][^)]*\)\([^)]*\)\([^)]*\)\([^)]*\)|\[N;H0;\+;X4\]",
    "SmilesIonizableNitrogenCount": r"\[[nN].*\+\]|\[NH2\]|\[NH\]|\[N-\]|\[NH-\]",
    "SmilesIonizableOxygenCount": r"\[O-\]|\[OH\]",
    "SmilesPhenolCount": r"c1[c]cccc1O|Oc1[c]cccc1",
    "SmilesNAlkylCount": r"NC|\[NH2\]C|\[NH\]C",
    "SmilesTertiaryAmineBasicCount": r"N\([^)]+\)\([^)]+\)\([^)]+\)",
    "SmilesImidazoleBasicCount": r"c1nccn1|c1ncnc1",
    "SmilesIonizablePhenolCount": r"c1[c]cccc1\[O-\]|c1[c]cccc1\[OH\]",
    "SmilesIonizablePhosphorusCount": r"\[P\+\]|\[P-\]|P\(=O\)\(O[H]?\)",
    "SmilesIonizablePyridineCount": r"\[n\+\]|n[H]?\+",
    "SmilesIonizableAmineCount": r"\[NH3\+\]|\[NH2\+\]|\[NH\+\]|\[N\+\]",
    "SmilesIonizableImidazoleCount": r"c1ncc\[nH\+\]1|c1ncc\[n\+\]1",
    "SmilesIsocyanideCount": r"N#C|C#N",
    "SmilesIonizableSulfonamideCount": r"S\(=O\)\(=O\)\(\[N-\]|N\[H\]\)",
    "SmilesSulfonateCount": r"S\(=O\)\(=O\)\[O-\]|OS\(=O\)\(=O\)O",
    "SmilesSulfonicAcidCount": r"S\(=O\)\(=O\)O|S\(=O\)\(=O\)OH",
    "SmilesPhosphateAnionCount": r"P\(=O\)\(\[O-\]\)\(O\)O|P\(=O\)\(O\)\(O\)\[O-\]",
    "SmilesFluorinatedFragmentCount": r"[Cc](F|\[F\])+",
    "SmilesIonizableSulfurCount": r"\[S\+\]|\[S-\]|\[SH\]|S\[H\]",
    # The longer alternative stands before the one that it begins with: engines that take the first and the longest match then agree.
    "SmilesGeneralAmmoniumCount": r"\[NH4\+\]|\[N\+\]\([^)]*\)|\[N\+\]",
    "SmilesKetoneCount": r"C\(=O\)C",
    "SmilesPrimaryAmineCount": r"\[NH2\]|N\([H]\)\([H]\)",
    "SmilesSecondaryAmineCount": r"\[NH\]|N\([H]\)\([^H][^)]*\)",
    "SmilesAmideCount": r"C\(=O\)N|NC\(=O\)",
    "SmilesNitroCount": r"\[N\+\]\(=O\)\[O-\]|N\(=O\)=O",
    "SmilesAlcoholCount": r"CO|\[OH\]|O\[H\]",
    "SmilesAlkyneCount": r"C#C",
    "SmilesNitrileCount": r"C#N",
    "SmilesIsocyanateCount": r"N=C=O",
    "SmilesThiocyanateCount": r"S=C=N|N=C=S",
    "SmilesAldehydeCount": r"[CH1]=O|[cH1]=O|C\(=O\)\[H1?\]|c\(=O\)\[H1?\]|C\[H1?\]=O|c\[H1?\]=O",
    "SmilesAnhydrideCount": r"[Cc]\(=O\)O[Cc]\(=O\)",
    "SmilesPhenylCount": r"c1ccccc1",
    "SmilesBenzylCount": r"c1ccccc1C",
    "SmilesPyridineCount": r"c1ccncc1|c1cnccc1|c1cncc1",
    "SmilesPyrimidineCount": r"c1cncnc1|c1ncncc1|c1nccnc1|c1ncncn1|c1ncnc[nH]1|c1nc[nH]cn1",
    "SmilesPyrroleCount": r"c1cc[nH]c1|c1c[nH]cc1|c1[nH]ccc1|\[nH\]1cccc1|c1ccc[nH]1",
    "SmilesFuranCount": r"c1ccoc1|c1cocc1",
    "SmilesThiopheneCount": r"c1ccsc1|c1sccc1",
    "SmilesPiperidineCount": r"C1CCNCC1|N1CCCCC1",
    "SmilesPiperazineCount": r"C1CNCCN1|N1CCNCC1",
    "SmilesMorpholineCount": r"C1COCCN1|N1CCOCC1|O1CCNCC1",
    "SmilesThiomorpholineCount": r"C1CSCN1|C1NCSC1|C1SCNC1|C1CNSC1|S1CCNC1|N1CCSC1|S1CNCC1|N1CSCC1",
    "SmilesCarbamatCount": r"NC\(=O\)O|OC\(=O\)N",
    "SmilesUreaCount": r"NC\(=O\)N",
    "SmilesThioureaCount": r"NC\(=S\)N",
    "SmilesOximeCount": r"C=NO|N=CO",
    "SmilesHydrazoneCount": r"C=NN|N=CN",
    "SmilesHydrazideCount": r"C\(=O\)NN|NNC\(=O\)",
    "SmilesAzideCount": r"\[N-\]=\[N\+\]=N|N=\[N\+\]=\[N-\]|\[N-\]\[N\+\]#N|N#\[N\+\]\[N-\]",
    "SmilesDiazoCount": r"[Cc]=N=N|N=N=[Cc]|[Cc]=\[N\+\]=\[N-\]|\[N-\]=\[N\+\]=[Cc]|[Cc]-\[N\+\]#N|N#\[N\+\]-[Cc]",
    "SmilesDisulfideCount": r"S-S|SS",
    "SmilesPhosphateCount": r"P\(=O\)\(O\)\(O\)O|OP\(=O\)",
    "SmilesSulfonamideCount": r"S\(=O\)\(=O\)N|NS\(=O\)\(=O\)",
    "SmilesSpiroCompoundCount": r"\[.\]1[^1]*\[.\]2[^2]*1[^1]*2",
    "SmilesFusedRingCount": r"\[.\]1[^1]*\[.\]2[^2]*\[.\][^1]*1[^2]*2",
    "SmilesBiphenylCount": r"c1ccccc1-c1ccccc1",
    "SmilesNaphthaleneCount": r"c1ccc2ccccc2c1",
    "SmilesIndoleCount": r"c1ccc2c\(c1\)[nH]cc2|c1ccc2c\(c1\)nc[cH]2|c1ccc2c\(c1\)c[nH]c2|c1ccc2c\(c1\)cc[nH]c2|c1ccc2[nH]ccc2c1|c1ccc2c[nH]cc1",
    "SmilesBenzimidazoleCount": r"c1ccc2c\(c1\)nc[nH]2|c1ccc2c\(c1\)[nH]cn2|c1ccc2ncn[cH]2|c1nc2ccccc2[nH]1|c1[nH]c2ccccc2nc1",
    "SmilesBenzothiazoleCount": r"c1ccc2c\(c1\)ncs2|c1ccc2c\(c1\)scn2|c1nc2ccccc2s1|c1sc2ccccc2n1",
    "SmilesBenzoxazoleCount": r"c1ccc2c\(c1\)nco2|c1ccc2c\(c1\)ocn2|c1nc2ccccc2o1|c1oc2ccccc2n1",
}

#: Matches of a pattern over the length of the text. Ring sizes are left to the ring perception.
PATTERN_FRACTIONS: dict[str, str] = {
    "SmilesMethylFraction": r"(^|[^a-zA-Z0-9])C([^a-zA-Z0-9]|$)|\[CH3\]|C\(H\)\(H\)H|\[C;H3\]|\[C@@H3\]|\[C@H3\]|\[C;H3;!R\]",
    "SmilesEthylFraction": r"CC([^a-zA-Z0-9]|$)|\[CH2\]\[CH3\]|C\(C\)C|\[CH2CH3\]|\[CH2\]\[C;H3\]|C\[CH2\]|\[C;H2\]\[C;H3\]|\[CH2\]C|C\[CH3\]|\[CH2\]\[CH2\]\[CH3\]",
    "SmilesHydroxylFraction": r"O[H]|\[OH\]|\[O\]H|\[O;H1\]|\[OH-\]|\[O-\]|\[O;H1;!R\]|O\(H\)|\[OH2\]|\[O;H2\]|\[O;H3\]|\[O;H0\]|\[O;H1;R0\]|\[O;H1;R1\]|\[O;H1;R2\]",
    "SmilesCarboxylFraction": r"C\(=O\)O|C\(=O\)\[OH\]|\[COOH\]|\[C\(=O\)O\]|\[C\(=O\)\[O-\]\]|\[C\(=O\)OH\]|OC\(=O\)|O=C\(O\)|\[C\(=O\)OH2\]|\[C\(=O\)O-\]|\[C;H0;X3\]\(=O\)O|\[C;H0;X3\]\(=O\)\[O-\]|\[C;H0;X3\]\(=O\)\[OH\]",
    "SmilesCarbonylFraction": r"C=O|C\(=O\)|\[C=O\]|\[C\(=O\)\]|\[C;H0;X3\]|\[C;H0;X3;!R\]|O=C|\[C;H0;X3;R0\]|\[C;H0;X3;R1\]|\[C;H0;X3;R2\]|\[C;H0;X3;R3\]",
    "SmilesEsterFraction": r"C\(=O\)OC|OC\(=O\)C|\[C;H0;X3\]\(=O\)OC|\[C;H0;X3\]\(=O\)O\[C;H3\]|\[C;H0;X3\]\(=O\)O\[C;H2\]|\[C;H0;X3\]\(=O\)O\[CH3\]|\[C;H0;X3\]\(=O\)O\[CH2\]",
    "SmilesEtherFraction": r"COC|\[CH2\]O\[CH3\]|\[CH2\]O\[CH2\]|\[COC\]|\[C;H2\]O\[C;H3\]|CO\[CH3\]|\[CH2\]OC|\[C;H2\]O\[C;H2\]|S\(C\)C|C\(O\)C|\[CH2\]O|O\[CH2\]|\[C;H2\]O|O\[C;H2\]",
    "SmilesKetoneFraction": r"([Cc])C\(=O\)([Cc])|([Cc])\(=O\)([Cc])",
    "SmilesAlcoholFraction": r"([CcX4])O\[H\]|([CcX4])OH|([CcX4])O$|([CcX4])O[^a-zA-Z]",
    "SmilesOxoFraction": r"C=O([^a-zA-Z]|$)|C\(=O\)([^a-zA-Z]|$)",
    "SmilesEtherBridgeFraction": r"([Cc])O([Cc])O([Cc])|O([Cc])O",
    "SmilesMethoxyFraction": r"O([Cc])([^a-zA-Z0-9]|$)|\[OCH3\]",
    "SmilesBranchedEtherFraction": r"O\(([Cc])\)([Cc])|([Cc])O\(([Cc])\)",
    "SmilesAminoFraction": r"N([^a-zA-Z0-9]|$)|\[NH2\]|N\(\[H\]\)\[H\]|\[N;H2\]|\[NH2\+\]|\[NH2-\]|\[N;H2;!R\]|N\(H\)H|\[NH3\]|\[NH3\+\]|\[NH\]|\[N;H1\]|N\(H\)|\[N;H\]|\[N;H3\]|\[N;H0\]|\[N;H1;R0\]|\[N;H2;R1\]",
    "SmilesNitrileFraction": r"([Cc])#N|N#([Cc])|C#N|\[C\]#\[N\]|\[C;H0\]#\[N\]|\[C;H0\]#\[N;H0\]",
    "SmilesIsocyanateFraction": r"N=C=O|O=C=N",
    "SmilesImineFraction": r"C=N|\[CH\]=N|\[C;H1\]=N|C=\[NH\]|\[N\]=C|N=CH|N=C|\[N\]=CH|\[N\]=C|\[CH\]=N|\[C\]=N",
    "SmilesPrimaryAmineFraction": r"N\[H2\]|\[NH2\]|N([^a-z0-9\(]|$)",
    "SmilesSecondaryAmineFraction": r"N\[H\]\(|\[NH\]\(|N\([^\)]+\)([^\(]|$)",
    "SmilesTertiaryAmineFraction": r"N\([^\)]+\)\([^\)]+\)\([^\)]+\)|N\([^\)]+\)\([^\)]+\)[^\(]",
    "SmilesQuaternaryAmmoniumFraction": r"\[N\+\]\(|\[nH?\+\]",
    "SmilesBranchedAmineFraction": r"N\(([Cc])\)([Cc])|([Cc])N\(([Cc])\)",
    "SmilesNAlkylFraction": r"N([Cc])|([Cc])N",
    "SmilesAromaticNitrogenCarbonFraction": r"([nc])",
    "SmilesThiolFraction": r"S[H]|\[SH\]|\[S;H1\]|\[SH-\]|\[S-\]|\[S;H1;!R\]|S\(H\)|\[SH2\]|\[S;H2\]|S[H2]|S\(H\)H",
    "SmilesThioetherFraction": r"CSC|\[CH2\]S\[CH3\]|\[CH2\]S\[CH2\]|\[CSC\]|\[C;H2\]S\[C;H3\]|CS\[CH3\]|\[CH2\]SC|\[C;H2\]S\[C;H2\]|S\(C\)C|C\(S\)C|\[CH2\]S|S\[CH2\]|\[C;H2\]S|S\[C;H2\]",
    "SmilesIsothiocyanateFraction": r"N=C=S|S=C=N",
    "SmilesSulfonylFraction": r"S\(=O\)\(=O\)|\[S\+2\]\(\[O-\]\)\(\[O-\]\)",
    "SmilesSulfoxideFraction": r"S\(=O\)([^\(=]|$)|\[S\+\]\(\[O-\]\)",
    "SmilesThiocyanateFraction": r"SC#N|N#CS",
    "SmilesIsothiocyanateLinearFraction": r"N=C=S|S=C=N",
    "SmilesCarbonSulfurBondFraction": r"([Cc])S|S([Cc])",
    "SmilesPhosphateFraction": r"P\(=O\)\(O\)O|OP\(=O\)\(O\)O",
    "SmilesPhosphonateFraction": r"P\(=O\)\(O\)([Cc])|([Cc])P\(=O\)\(O\)",
    "SmilesCarbonPhosphorusBondFraction": r"([Cc])P|P([Cc])",
    "SmilesAlkylHalideFraction": r"([CcX4])(F|Cl|Br|I|\[F\]|\[Cl\]|\[Br\]|\[I\])",
    "SmilesFluorinatedFragmentFraction": r"([Cc])F|F([Cc])",
    "SmilesTrifluoromethylFraction": r"CF3|C\(F\)\(F\)F|\[CF3\]",
    "SmilesAromaticHalideFraction": r"(c)(F|Cl|Br|I|\[F\]|\[Cl\]|\[Br\]|\[I\])",
    "SmilesAromaticNitroFraction": r"(c)\[N\+\]\(=O\)\[O-\]|(c)N\(=O\)=O",
    "SmilesAliphaticNitroFraction": r"([CcX4])\[N\+\]\(=O\)\[O-\]|([CcX4])N\(=O\)=O",
    "SmilesAzideFraction": r"N=\[N\+\]=\[N-\]|N=[N+]=[N-]",
    "SmilesDiazoFraction": r"N=N([^=]|$)|\[N\]=\[N\]",
    "SmilesNitrogenOxygenAdjacentFraction": r"NO|ON",
    "SmilesGuanidineFraction": r"N=C\(N\)N|NC\(=N\)N",
    "SmilesUreaFraction": r"N([CcX4]?)\(=O\)N|NC\(=O\)N",
    "SmilesAmidineFraction": r"([Cc])\(=N\)N|N=([Cc])N|NC\(=N\)",
    "SmilesSulfonamideFraction": r"S\(=O\)\(=O\)N|NS\(=O\)\(=O\)",
    "SmilesCarbamatePatternsFraction": r"NC\(=O\)O|OC\(=O\)N",
    "SmilesBranchedAmideFraction": r"([Cc])\(=O\)N\(([Cc])\)|N\(([Cc])\)([Cc])\(=O\)",
    "SmilesImidazoleFraction": r"c1nccn1|c1cnc[nH]1|c1nc[nH]c1|[nH]1cncc1|n1cc[nH]c1|n1c[nH]cc1",
    "SmilesPyridineFraction": r"c1ccncc1|n1ccccc1|c1cccnc1|c1ccccn1",
    "SmilesPyrroleFraction": r"c1cc[nH]c1|[nH]1cccc1|c1c[nH]cc1|c1ccnc1",
    "SmilesFuranFraction": r"c1ccoc1|o1cccc1|c1cocc1|c1ccco1",
    "SmilesThiopheneFraction": r"c1ccsc1|s1cccc1|c1cscc1|c1cccs1",
    "SmilesImidazoliumFraction": r"\[nH\+\]|n\+",
    "SmilesPyridiniumFraction": r"\[n\+\]|n\+",
    "SmilesMixedHeteroatomRingFraction": r"c1[nos]c[nos]c1|[nos]1c[nos]cc1|[nos]1cc[nos]c1",
    "SmilesImidazoleBasicFraction": r"c1nccn1|n1cncc1|n1ccnc1",
    "SmilesPyridineBasicFraction": r"c1ccncc1|n1ccccc1|c1cccnc1",
    "SmilesAromaticNitrogenRingFraction": r"n1[a-z][a-z][a-z][a-z][a-z]1|[a-z]1[a-z][a-z][a-z][a-z]n1|[a-z]1[a-z][a-z][a-z]n[a-z]1|[a-z]1[a-z][a-z]n[a-z][a-z]1|[a-z]1[a-z]n[a-z][a-z][a-z]1|[a-z]1n[a-z][a-z][a-z][a-z]1",
    "SmilesOxygenAromaticRingFraction": r"o1[a-z][a-z][a-z][a-z][a-z]1|[a-z]1[a-z][a-z][a-z][a-z]o1|[a-z]1[a-z][a-z][a-z]o[a-z]1|[a-z]1[a-z][a-z]o[a-z][a-z]1|[a-z]1[a-z]o[a-z][a-z][a-z]1|[a-z]1o[a-z][a-z][a-z][a-z]1",
    "SmilesAromaticRingFraction": r"c1ccccc1|c1ccccc1|c1ccccc1|c1ccccc1",
    "SmilesComplexRingClosureFraction": r"[0-9][0-9]|%[0-9][0-9]",
    "SmilesCyclopropylFraction": r"C1CC1|C\(C\)\(C\)|C1=CC1",
    "SmilesCyclobutylFraction": r"C1CCC1|C1=CCC1|C1C=CC1|C1CC=C1",
    "SmilesCyclopentylFraction": r"C1CCCC1|C1C=CCC1|C1CC=CC1|C1CCC=C1|C1=CCCC1",
    "SmilesCyclohexylFraction": r"C1CCCCC1|C1C=CCCC1|C1CC=CCC1|C1CCC=CC1|C1CCCC=C1|C1=CCCCC1",
    "SmilesDoubleBondRingJunctionFraction": r"C=C[1-9]|C=[C]%[0-9][0-9]",
    "SmilesAliphaticChainFraction": r"CCC|[CH2][CH2][CH2]",
    "SmilesAromaticSequenceFraction": r"ccc",
    "SmilesTertiaryCarbonFraction": r"C\([^\)]+\)\([^\)]+\)\([^\)]+\)|C\([^\)]+\)\([^\)]+\)([^\(]|$)",
    "SmilesQuaternaryCarbonFraction": r"C\([^\)]+\)\([^\)]+\)\([^\)]+\)\([^\)]+\)",
    "SmilesHeteroatomSequenceFraction": r"[CNOScnos][CNOScnos]",
    "SmilesConjugatedSystemFraction": r"C=CC=C|c=cc=c|C=Cc=C|c=CC=c",
    "SmilesLongCarbonChainFraction": r"CCCC|[CH2][CH2][CH2][CH2]",
    "SmilesDimethylFraction": r"CC\(C\)C|C\(C\)\(C\)C",
    "SmilesAromaticAlkylFraction": r"(c)([CX4])|([CX4])(c)",
    "SmilesAlkeneFraction": r"C=C|C\\C|C/C",
    "SmilesAlkyneFraction": r"C#C",
    "SmilesTerminalAlkyneFraction": r"C#C([^a-zA-Z]|$)|C#[CH]",
    "SmilesAcidicOxygenFraction": r"([Cc]|S|P)\(=O\).*O(\[H\])?|([Cc]|S|P)\(=O\)O",
    "SmilesAcidicSulfurFraction": r"S\(=O\)(\(=O\))?O(\[H\])?|S\(=O\)(\(=O\))?\[OH\]",
    "SmilesAcidicPhosphorusFraction": r"P\(=O\)\(O\)O(\[H\])?|P\(=O\)\(\[OH\]\)\[OH\]",
    "SmilesPhenolFraction": r"(c)O(\[H\])?|(c)OH|(c)\[OH\]",
    "SmilesCarboxylateFraction": r"([Cc])\(=O\)\[O-\]|\[O-\]([Cc])=O|OC\(=\[O-\]\)",
    "SmilesSulfonateFraction": r"S\(=O\)\(=O\)\[O-\]|S\(\[O-\]\)\(=O\)=O",
    "SmilesPhosphateAnionFraction": r"P\(=O\)\(O\)\[O-\]|P\(\[O-\]\)\(=O\)O",
    "SmilesGuanidineBasicFraction": r"N=C\(N\)N|NC\(=[NH]\)N|NC\(N\)=N",
    "SmilesAmidineBasicFraction": r"([Cc])\(=N\)N|N=([Cc])N|N([Cc])=N",
    "SmilesQuaternaryAmmoniumBasicFraction": r"\[N\+\]|N\+",
    "SmilesAmmoniumFraction": r"\[NH4\+\]|NH4\+",
    "SmilesSulfoniumFraction": r"\[S\+\]|S\+",
    "SmilesPhosphoniumFraction": r"\[P\+\]|P\+",
    "SmilesAcidicHydrogenFraction": r"\[(O|S|N)H\]|OH|SH|NH",
    "SmilesIonizableOxygenFraction": r"\[O-\]|\[OH\]|O-|OH",
    "SmilesIonizableNitrogenFraction": r"\[[nN].*\+\]|\[NH2\]|\[NH\]|[nN]\+|NH[12]?",
    "SmilesIonizableSulfurFraction": r"\[S-\]|\[SH\]|S-|SH",
    "SmilesIonizablePhosphorusFraction": r"\[P-\]|\[PH\]|P-|PH",
    "SmilesIonizableCarboxylFraction": r"([Cc])\(=O\)(\[O-\]|O\[H\]|O-|OH)|([Cc])\(O-\)=O|([Cc])\(OH\)=O",
    "SmilesIonizablePhenolFraction": r"(c)(\[O-\]|O\[H\]|O-|OH)",
    "SmilesIonizableThiolFraction": r"\[SH\]|\[S-\]|SH|S-",
    "SmilesIonizableAmineFraction": r"\[[nN].*\+\]|\[NH2\]|\[NH\]|[nN]\+|NH[12]?",
    "SmilesIonizableImidazoleFraction": r"\[nH\]|\[nH\+\]|nH|nH\+",
    "SmilesIonizablePyridineFraction": r"\[n\+\]|\[nH\+\]|n\+|nH\+",
    "SmilesIonizableSulfonamideFraction": r"S\(=O\)\(=O\)(\[N-\]|N\[H\]|N-|NH)|\[N-\]S\(=O\)\(=O\)|\[NH\]S\(=O\)\(=O\)",
    "SmilesIonizablePhosphonateFraction": r"P\(=O\)\(O\)(\[O-\]|O\[H\]|O-|OH)|P\(=O\)\(\[O-\]\)\[OH\]|P\(=O\)\(OH\)\[O-\]",
    "SmilesIsotopeFraction": r"\[[0-9]+[A-Za-z]{1,2}",
    "SmilesCarbonylHeteroatomFraction": r"([Cc])\(=O\)[NOS]|[NOS]([Cc])=O",
    "SmilesAdjacentHeteroatomFraction": r"[NOSPFnospf][NOSPFnospf]",
    "SmilesAromaticCarbonHeteroatomFraction": r"(c)[NOSPnospf]|[NOSPnospf](c)",
    "SmilesAliphaticCarbonHeteroatomFraction": r"([CX4])[NOSPnospf]|[NOSPnospf]([CX4])",
    "SmilesPrimaryAmineBasicFraction": r"N\[H2\]|\[NH2\]|N([^a-z0-9\(]|$)",
    "SmilesSecondaryAmineBasicFraction": r"N\[H\]\(|\[NH\]\(|N\([^\)]+\)([^\(]|$)",
    "SmilesTertiaryAmineBasicFraction": r"N\([^\)]+\)\([^\)]+\)\([^\)]+\)|N\([^\)]+\)\([^\)]+\)[^\(]",
}
