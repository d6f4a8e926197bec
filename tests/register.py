"""A slice of a public timetable register, typed in: fixed values that expected results are known for."""

# (id, name, region, lat, lon)
STOPS = [
    ("op:54:54098", "«ОП «Вокзал «Новосибирск-Главный»", "54", 55.03631869523268, 82.89818682076192),
    ("op:22:22007", "Каменская автостанция", "22", 53.7901957064213, 81.315934187835),
    ("op:22:22163", "Крутихинский ОП", "22", 53.965376395374825, 81.2134006640053),
    ("op:54:54006", "АС рп Ордынское", "54", 54.3635398031301, 81.9086985848844),
    ("op:54:54017", "ДКП «Юго-Западная» г. Новосибирск", "54", 54.9714799207, 82.8728526199),
    ("op:54:54099", "АВ «Новосибирский автовокзал-Главный»", "54", 55.0409859734935, 83.0275267575736),
    ("op:70:70016", "Автовокзал АО «Томскавтотранс»", "70", 56.4612664816162, 84.9912958591767),
    ("op:54:54021", "Автостанция г. Болотное", "54", 55.66842282171524, 84.39373020082148),
    ("op:22:22165", "АВ г. Барнаул", "22", 53.3517518948, 83.758644294),
    ("op:54:54040", "ОП пгт Линево", "54", 54.4545075867456, 83.3558348379782),
    ("op:54:54020", "ДКП г. Искитим", "54", 54.6113220952968, 83.2808032259345),
    ("op:54:54106", "ОП «Речной»", "54", 55.008070590379944, 82.93647936902936),
    ("op:54:54107", "ОП «Речной вокзал»", "54", 55.008070590379944, 82.93647936902936),
    ("op:54:54042", "ОП с. Безменово", "54", 55.8348014340681, 84.7491340935174),
    ("op:54:54019", "ОП г. Бердск", "54", 54.761974339161014, 83.11377310405305),
    ("op:22:22070", "ОП с. Масляха", "22", 54.051414244758725, 81.26924386247678),
]

# (route, direction, [(stop number, winter days, departures, arrivals, summer days, departures, arrivals)])
SCHEDULES = [
    ("54.22.078", "forward", [
        (0, "ежедневно", ["12:30"], [], None, [], []),
        (11, "ежедневно", ["12:45"], ["12:40"], None, [], []),
        (14, "ежедневно", ["13:20"], ["13:19"], None, [], []),
        (10, "ежедневно", ["13:50"], ["13:45"], None, [], []),
        (9, "ежедневно", ["14:10"], ["14:10"], None, [], []),
        (13, "ежедневно", ["14:45"], ["14:45"], None, [], []),
        (8, "ежедневно", [], ["17:00"], None, [], []),
    ]),
    ("54.22.049", "forward", [
        (0, "ежедневно", ["06:49"], [], None, [], []),
        (12, "ежедневно", ["06:59"], ["06:57"], None, [], []),
        (11, "нет отправлений", [], [], None, [], []),
        (8, "ежедневно", [], ["11:19"], None, [], []),
    ]),
    ("54.70.040", "forward", [
        (5, "ежедневно", ["10:00"], [], None, [], []),
        (0, "ежедневно", ["10:40"], ["10:35"], None, [], []),
        (7, "ежедневно", ["13:10"], ["13:05"], None, [], []),
        (6, "ежедневно", [], ["15:00"], None, [], []),
    ]),
    ("54.22.030", "forward", [
        (0, "ежедневно", ["07:30"], [], None, [], []),
        (4, "ежедневно", ["08:00"], ["07:50"], None, [], []),
        (3, "ежедневно", ["09:40"], ["09:30"], None, [], []),
        (15, "ежедневно", ["10:30"], ["10:25"], None, [], []),
        (2, "ежедневно", ["10:50"], ["10:45"], None, [], []),
        (1, "ежедневно", [], ["11:20"], None, [], []),
    ]),
    ("54.22.078", "backward", [
        (8, "ежедневно", ["19:59"], [], None, [], []),
        (13, "ежедневно", ["21:45"], ["21:45"], None, [], []),
        (9, "ежедневно", ["22:25"], ["22:25"], None, [], []),
        (10, "ежедневно", ["22:50"], ["22:45"], None, [], []),
        (14, "ежедневно", ["23:10"], ["23:10"], None, [], []),
        (11, "ежедневно", ["23:50"], ["23:45"], None, [], []),
        (0, "ежедневно", [], ["00:00"], None, [], []),
    ]),
    ("54.22.049", "backward", [
        (8, "ежедневно", ["14:44"], [], None, [], []),
        (11, "ежедневно", ["18:59"], ["18:54"], None, [], []),
        (12, "нет отправлений", [], [], None, [], []),
        (0, "ежедневно", [], ["19:14"], None, [], []),
    ]),
    ("54.70.040", "backward", [
        (6, "ежедневно", ["18:00"], [], None, [], []),
        (7, "ежедневно", ["20:00"], ["19:55"], None, [], []),
        (0, "ежедневно", ["22:05"], ["22:00"], None, [], []),
        (5, "ежедневно", [], ["22:25"], None, [], []),
    ]),
    ("54.22.030", "backward", [
        (1, "ежедневно", ["14:50"], [], None, [], []),
        (2, "ежедневно", ["15:25"], ["15:20"], None, [], []),
        (15, "ежедневно", ["15:45"], ["15:40"], None, [], []),
        (3, "ежедневно", ["16:30"], ["16:25"], None, [], []),
        (4, "ежедневно", ["18:20"], ["18:10"], None, [], []),
        (0, "ежедневно", [], ["18:40"], None, [], []),
    ]),
]
