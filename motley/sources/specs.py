"""Declarative description of every employee source."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SourceSpec:
    """How one raw table maps to the canonical employee row."""

    name: str
    salary: str
    title: str
    hired: str
    gender: str
    male: str
    ethnicity: str | None
    employer: str
    full_time: tuple[str, str] | None = None
    layout: str = "tail"
    encoding: str = "UTF-8"
    numeric_salary: bool = False
    hours: str | None = None
    drop_salary: str | None = None
    in_catalog: bool = True

    def columns(self) -> dict[str, str]:
        """Canonical name -> raw column, for the columns this source has."""
        found = {
            "salary": self.salary, "job_title": self.title, "hired": self.hired,
            "gender": self.gender, "ethnicity": self.ethnicity, "hours": self.hours,
        }
        return {k: v for k, v in found.items() if v is not None}


# Column names, filters and date layouts of the known sources.
SPECS = [
    SourceSpec("austin_city", "Annual Salary", "Title", "Date of Employment", "Gender", "M",
               "Ethnicity", "city", ("Part Time/Full Time", "Full Time")),
    SourceSpec("bexar_county", "Annual Salary", "Position Title", "Hire Date", "Gender", "Male",
               "Race", "county", ("Fulltime/Part-Time", "Fulltime"), numeric_salary=True),
    SourceSpec("dallas_city", "Rate of Pay", "Job Code Description", "Hire Date", "Gender", "M",
               "Ethnicity", "city", ("Status Description", "Active Full-time (Permanent)"),
               hours="Annual Hours"),
    SourceSpec("fort_worth_city", "Annual Rt", "Job", "Last Start", "Sex", "M",
               "Ethnic Grp", "city", ("Full/Part Time", "Full-Time")),
    SourceSpec("houston_city", "Annual Salary", "Job Title", "Hire Date", "Gender", "Male",
               "Racial Category", "city", ("Employee Grp", "Full Time"), drop_salary="0"),
    SourceSpec("san_antonio_city", "FY18 ANNUAL SALARY2", "JOB TITLE", "HIRE DATE1", "GENDER", "MALE",
               "ETHNIC ORIGIN10", "city"),
    SourceSpec("tarrant_county", "Budgeted Annual Salary", "Name of Position", "Hire Date", "Gender", "Male",
               "Race", "county"),
    SourceSpec("texas_state", "ANNUAL", "CLASS TITLE", "EMPLOY DATE", "GENDER", "Male",
               "ETHNICITY", "state", ("HRS PER WK", "40"), layout="two_digit", numeric_salary=True,
               in_catalog=False),
    SourceSpec("ut_am", "Annual Budgeted Salary", "Title Description", "Curr Empl Date", "Gender", "Male",
               "Race-Ethnicity", "university", ("Part/Full Time", "F"), layout="last4"),
    SourceSpec("ut_austin", "Annual Salary Rate", "Title", "Hire Date", "Gender", "Male",
               "RaceEthinicity", "university", ("Fulltime or Parttime", "Full-time"),
               encoding="ISO-8859-1"),
    SourceSpec("ut_galveston", "ANNUAL_PAY", "JOBTITLE", "LAST_HIRE_DT", "GENDER", "Male",
               "ETHNIC_GROUP_DESCR", "hospital", ("FULL_PART_TIME", "Full-time"), layout="at6"),
    SourceSpec("ut_houston", "Annual Rt", "Job Title", "Orig Hire Date", "Sex", "M",
               "Ethnic Grp", "university", ("Full/Part", "F"), layout="at6"),
    SourceSpec("ut_houston_health", "Total Base Comp", "Job Title", "Original Hire Date", "Gender", "M",
               "Ethnicity - Consolidated", "hospital", ("Employment Status", "F"), layout="at6"),
    SourceSpec("ut_md_anderson", "Annual Rate", "Job Title", "First Start Date", "Gender", "Male",
               "Ethnic Grp", "hospital", ("Full/Part Time", "Full-Time"), layout="at6",
               encoding="ISO-8859-1", numeric_salary=True),
    SourceSpec("ut_sa_health", "Comp Rate", "Job Title", "Rehire Dt", "Sex", "Male",
               "Ethnic Grp", "hospital", ("Full/Part", "Full-Time"), layout="at6",
               encoding="ISO-8859-1"),
    SourceSpec("ut_sw_medical", "Annual Pay", "Job Code Description", "Date First Hire", "Gender", "Male",
               None, "hospital", ("Full Time Type Description", "Full-Time"), layout="at6",
               numeric_salary=True, in_catalog=False),
]

# Order of the employer types in one-hot and integer form.
EMPLOYER_TYPES = ("city", "county", "university", "hospital")

# Spelling -> ethnicity code.
ETHNICITY_CODES = {
    "White": 1,
    "Hispanic or Latino": 3,
    "Black or African American": 2,
    "Asian": 5,
    "Choose Not To Disclose": -1,
    "Two or more races": 6,
    "American Indian/Alaska Native": 4,
    "Native Hawaiian/Pacific Isl": 5,
    "(Invalid) Other": -1,
    "(Invalid) Asian/Pacific Isl": 5,
    "Hispanic/Latino": 3,
    "Two or More Races": 6,
    "American Indian or Alaskan Native": 4,
    "Native Hawaiian or Pacific Islander": 5,
    "OTHR": -1,
    "WHT": 1,
    "BLK": 2,
    "ASIN": 5,
    "MEXA": 3,
    "OASI": -1,
    "SPAN": 3,
    "KORN": 5,
    "PUER": 3,
    "TWO": 6,
    "AMIN": 4,
    "VIET": 5,
    "CUBA": 3,
    "GUAM": 3,
    "CHIN": 5,
    "FILI": 5,
    "HAWA": 5,
    "JAPN": 5,
    "PACF": 5,
    "SAMO": 5,
    "WHITE": 1,
    "ASIAN": 5,
    "BLACK": 2,
    "HISPA": 3,
    "AMIND": 4,
    "2ORMORE": 6,
    "PACIF": 5,
    "NSPEC": -1,
    "Native Hawaiian or Other Pacific Islander": 5,
    "WHITE (NON HISPANIC OR LATINO)": 1,
    "HISPANIC OR LATINO": 3,
    "BLACK OR AFRICAN AMERICAN (NON HISPANIC OR LATINO)": 2,
    "ASIAN (NON HISPANIC OR LATINO)": 5,
    "TWO OR MORE RACES (NON HISPANIC OR LATINO)": 6,
    "AMERICAN INDIAN OR ALASKA NATIVE (NONHISPANIC/LAT)": 4,
    "NATIVE HAWAIIAN/OTHER PACIFIC ISLANDER (NON HIS)": 5,
    "OTHER": -1,
    "NATIVE AMERICAN/ALASKAN": 4,
    "UNKNOWN": -1,
    "Black": 2,
    "American Indian/Alaskan Native": 4,
    "0": -1,
    "Declined to Specify": -1,
    "American Indian or Alaska Native": 4,
    "Non Resident Alien": -1,
    "Unknown": -1,
    "Black/African American": 2,
    "Two-or-more": 6,
    "Native Hawaiian/Oth Pac Island": 5,
    "Not Applicable": -1,
    "NHISP": 3,
    "not available": -1,
    "2+RACE": 6,
    " ": -1,
}


def catalog_specs(exclude: list[str] | None = None) -> list[SourceSpec]:
    """The catalogued sources in order, without the excluded names."""
    unknown = set(exclude or []) - {s.name for s in SPECS}
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return [s for s in SPECS if s.in_catalog and s.name not in set(exclude or [])]
