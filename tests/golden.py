"""Published yearly rates of the United States and results known for them."""

# Year, inflation, growth, unemployment (percent).
RATES = [
    (1970, 5.83825533848251, 0.216606498194878, 4.9),
    (1971, 4.29276668813051, 3.29272245005524, 5.9),
    (1972, 3.27227824655283, 5.25550195781351, 5.6),
    (1973, 6.17776006377038, 5.64567976314829, 4.9),
    (1974, 11.0548048048048, -0.540550192633191, 5.6),
    (1975, 9.14314686496535, -0.205619191121627, 8.5),
    (1976, 5.74481263549085, 5.38803391770217, 7.7),
    (1977, 6.5016839947284, 4.62418650601657, 7.1),
    (1978, 7.63096383885606, 5.53520648243719, 6.1),
    (1979, 11.2544711292795, 3.16598821816159, 5.8),
    (1980, 13.5492019749684, -0.256775731395592, 7.1),
    (1981, 10.3347153402771, 2.53770126828974, 7.6),
    (1982, 6.13142700027493, -1.80301378934359, 9.7),
    (1983, 3.21243523316065, 4.58379098362749, 9.6),
    (1984, 4.30053547523429, 7.23645316474058, 7.5),
    (1985, 3.54564415209365, 4.16957534699196, 7.2),
    (1986, 1.89804772234276, 3.46265505694664, 7.0),
    (1987, 3.6645632175169, 3.45462966856461, 6.2),
    (1988, 4.07774110744413, 4.1769823865164, 5.5),
    (1989, 4.82700303008944, 3.67223784383981, 5.3),
    (1990, 5.39795643990325, 1.88596558187626, 5.6),
    (1991, 4.23496396453849, -0.108312882368935, 6.8),
    (1992, 3.02881967814969, 3.52249717301392, 7.5),
    (1993, 2.95165696638559, 2.75179586709815, 6.9),
    (1994, 2.60744159215453, 4.02902272983438, 6.119),
    (1995, 2.80541968853662, 2.6844307317787, 5.65),
    (1996, 2.93120419993441, 3.77277269119453, 5.451),
    (1997, 2.33768993730735, 4.44712793566428, 5.0),
    (1998, 1.55227909874364, 4.48313335374613, 4.511),
    (1999, 2.18802719697358, 4.78842504725272, 4.219),
    (2000, 3.37685727149929, 4.07758575682804, 3.992),
    (2001, 2.82617111885407, 0.955538348341605, 4.731),
    (2002, 1.58603162650601, 1.70044732643726, 5.783),
    (2003, 2.27009497336115, 2.79560596320081, 5.989),
    (2004, 2.67723669309172, 3.84777169556921, 5.529),
    (2005, 3.3927468454955, 3.48354993555606, 5.084),
    (2006, 3.22594410070404, 2.78453963650701, 4.623),
    (2007, 2.85267248150138, 2.00385829784946, 4.622),
    (2008, 3.839100296651, 0.113587249881704, 5.784),
    (2009, -0.355546266299747, -2.57650022958367, 9.254),
    (2010, 1.6400434423899, 2.69519257744442, 9.633),
    (2011, 3.156841568622, 1.56440685763506, 8.949),
    (2012, 2.06933726526067, 2.28911338669843, 8.069),
    (2013, 1.46483265562717, 2.11783009790057, 7.375),
    (2014, 1.62222297740817, 2.52381981363968, 6.168),
    (2015, 0.118627135552451, 2.94555045484053, 5.28),
    (2016, 1.26158320570536, 1.81945147788167, 4.869),
    (2017, 2.13011000365961, 2.45762229852507, 4.355),
    (2018, 2.44258329692817, 2.96650506901305, 3.896),
    (2019, 1.81221007526021, 2.58382533412825, 3.669),
    (2020, 1.23358439630629, -2.16302914036166, 8.055),
    (2021, 4.69785886363742, 6.05505293244555, 5.349),
    (2022, 8.00279982052121, 2.51237531986017, 3.65),
    (2023, 4.11633838374488, 2.88755600749487, 3.638),
    (2024, 2.94952520485207, 2.79300127716779, 4.022),
]

# Benchmark rates of 2025 (inflation, growth, unemployment).
BENCHMARK = (2.57025747062293, 3.14179066402967, 4.4528)

# Years the strict rule calls a crisis.
STRICT_CRISIS_YEARS = [
    1973, 1974, 1975, 1979, 1980, 1982, 1983, 1987, 1991, 2000,
    2008, 2009, 2010, 2011, 2012, 2020, 2022,
]
LOOSE_CRISIS_YEAR_COUNT = 33

# Runs of crisis years when every year has a release.
CRISIS_BLOCKS = [
    (1973, 1975), (1979, 1980), (1982, 1983), (1987, 1987), (1991, 1991),
    (2000, 2000), (2008, 2012), (2020, 2020), (2022, 2022),
]
