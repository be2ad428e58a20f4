"""The regenerated 50-point reference and 5-point focal table (id, x, y, c0, c1)."""

REF = """
1,-0.5604756466,0.2533185140,-0.7104065637,0.7877388475
2,-0.2301774895,-0.0285467553,0.2568837092,0.7690422410
3,1.5587083141,-0.0428704573,-0.2466918785,0.3322025790
4,0.0705083914,1.3686022840,-0.3475425994,-1.0083766083
5,0.1292877352,-0.2257709857,-0.9516185673,-0.1194526066
6,1.7150649869,1.5164706044,-0.0450277248,-0.2803953352
7,0.4609162060,-1.5487528042,-0.7849044695,0.5629895332
8,-1.2650612346,0.5846137496,-1.6679419366,-0.3724387561
9,-0.6868528519,0.1238542438,-0.3802265203,0.9769733867
10,-0.4456619701,0.2159415687,0.9189966091,-0.3745808578
11,1.2240817974,0.3796394828,-0.5753469626,1.0527114656
12,0.3598138271,-0.5023234531,0.6079643222,-1.0491770067
13,0.4007714506,-0.3332073837,-1.6178827083,-1.2601552448
14,0.1106827159,-1.0185753831,-0.0555619655,3.2410399349
15,-0.5558411348,-1.0717912265,0.5194072039,-0.4168575882
16,1.7869131368,0.3035286414,0.3011533622,0.2982275915
17,0.4978504782,0.4482097786,0.1056761941,0.6365696740
18,-1.9666171566,0.0530042267,-0.6407060083,-0.4837806257
19,0.7013559016,0.9222674679,-0.8497043460,0.5168620443
20,-0.4727914077,2.0500846856,-1.0241287906,0.3689645274
21,-1.0678237060,-0.4910311661,0.1176465971,-0.2153805076
22,-0.2179749147,-2.3091688756,-0.9474746142,0.0652930335
23,-1.0260044483,1.0057385245,-0.4905574437,-0.0340672537
24,-0.7288912293,-0.7092007626,-0.2560921922,2.1284518990
25,-0.6250392678,-0.6880086165,1.8438620052,-0.7413360963
26,-1.6866933107,1.0255713697,-0.6519499017,-1.0959962671
27,0.8377870445,-0.2847730071,0.2353865723,0.0377883992
28,0.1533731178,-1.2207177123,0.0779608496,0.3104807494
29,-1.1381369370,0.1813034797,-0.9618566341,0.4365234789
30,1.2538149211,-0.1388913624,-0.0713080861,-0.4583653327
31,0.4264642215,0.0057641859,1.4445508584,-1.0633261340
32,-0.2950714830,0.3852804011,0.4515040531,1.2631851761
33,0.8951256610,-0.3706600318,0.0412329220,-0.3496503880
34,0.8781334875,0.6443765485,-0.4224968323,-0.8655128627
35,0.8215810816,-0.2204865618,-2.0532472215,-0.2362795689
36,0.6886402541,0.3317819639,1.1313372134,-0.1971758943
37,0.5539176535,1.0968390131,-1.4606400709,1.1099202897
38,-0.0619117106,0.4351814908,0.7399475109,0.0847372922
39,-0.3059626637,-0.3259315855,1.9091035692,0.7540537852
40,-0.3804710010,1.1488076185,-1.4438931610,-0.4992920172
41,-0.6947069789,0.9935038560,0.7017843354,0.2144453096
42,-0.2079172780,0.5483969595,-0.2621974894,-0.3246859115
43,-1.2653963516,0.2387317351,-1.5721441591,0.0945835282
44,2.1689559653,-0.6279060760,-1.5146676538,-0.8953633580
45,1.2079619983,1.3606524485,-1.6015361736,-1.3108015333
46,-1.1231085832,-0.6002595871,-0.5309065222,1.9972133847
47,-0.4028848353,2.1873329930,-1.4617555850,0.6007088237
48,-0.4666553536,1.5326106262,0.6879167730,-1.2512713616
49,0.7799651183,-0.2357003591,2.1001089405,-0.6111659167
50,-0.0833690665,-1.0264209003,-1.2870304760,-1.1854800846
"""

FOCAL = """
1,2.1988103489,-0.4762468946,0.1192452364,1.6756969324
2,1.3124129764,-0.7886028379,0.2436874296,-0.4411632169
3,-0.2651450567,-0.5946172675,1.2324758785,-0.7230659699
4,0.5431940592,1.6509074673,-0.5160638309,-1.2362731189
5,-0.4143399479,-0.0540281251,-0.9925071504,-1.2847157223
"""


def rows(text: str) -> list[tuple]:
    return [(int(a), *map(float, rest)) for a, *rest in (line.split(",") for line in text.split())]
